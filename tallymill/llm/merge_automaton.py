"""Byte-level BPE by a tokenization automaton (operator 10).

The automaton reads tokens: a state stands for the last token, and its arcs are the tokens that may follow in a correct
tokenization. It starts with all bytes following each other. Each merge (u, v) -> w in turn is a gadget: the state of w
is a copy of v's, an arc w is laid wherever there is an arc u, and the arc v leaves the state of u. A merge whose own
arc is gone by its turn can never apply and is dropped.

Compiled, a state keeps only what it does not share with the state it was copied from (its default). Tokens are numbered
so that what an arc leaving takes along, the token itself and all that are laid on it later, is one range of numbers;
a state's row is the list of range edges with the earliest turn at which an arc in the range left. An arc is looked up
in the rows along the chain of defaults, each read up to the turn of the copy.

A pre-split word is encoded by transitions alone, byte by byte and without a step back: one table leads from node to
node of a trie of all labels (with its fallbacks), each node names the tokens that end there, and the one whose arc
leaves the state of the place where it begins is the state of this place. Decoding emits the labels of the arcs.

Defined results: a null text is the empty text (no ids, empty string); control strings of the vocabulary inside a text
are their own ids, as the tokenizers library has it. Rows are independent; further columns pass through `encoded`.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import odd_signs, slices

#: Words, and arcs between pairs of tokens, that a Python worker remembers; beyond that it starts anew.
MEMORY, ARCS = 400_000, 1_000_000
#: Characters of texts whose new words are encoded together.
TOGETHER = 1 << 21
_NEVER = (1 << 31) - 1
#: How byte-level BPE splits a text into words before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for a text without signs that Python's classes take differently (`odd_signs`).
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        raw = lambda s: bytes(letters[c] for c in s)
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels: dict[int, bytes] = {i: raw(s) for s, i in vocab.items() if s not in self.control}
        self.labels |= {i: s.encode() for s, i in self.control.items()}
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self._words: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self._arcs: dict[int, bool] = {}
        cut: dict[tuple[int, int], int] = {}
        for s, i in vocab.items():
            if s in letters:
                self.born[i] = -1
        for turn, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in self.born and v in self.born and w not in self.born and not self._gone(cut, u, v, turn):
                cut[u, v] = turn
                self.born[w], self.left[w], self.right[w] = turn, u, v
        self._compile_arcs(cut)
        self._compile_bytes()
        self._plain, self._exact = re.compile(PLAIN_SPLIT), regex.compile(SPLIT)
        self._odd = np.zeros(0x110000, bool)
        self._odd[[ord(c) for c in odd_signs()]] = True
        self._control = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.control, key=len, reverse=True)) + ")") if self.control else None

    def _gone(self, cut: dict[tuple[int, int], int], a: int, b: int, before: int) -> bool:
        """Whether the arc b had left the state of a before that turn, while gadgets are still being laid."""
        while True:
            if cut.get((a, b), before) < before:
                return True
            x, y = self.born[a], self.born[b]
            if x == y == -1:
                return False
            if x == y:  # one token after itself: its last part before its first part
                a, b, before = self.right[a], self.left[b], x
            elif x > y:
                a, before = self.right[a], x
            else:
                u = self.left[b]
                if a == u == self.right[b]:  # u before uu: the arc u left the state of u in the same turn
                    return True
                b, before = u, y

    def _compile_arcs(self, cut: dict[tuple[int, int], int]) -> None:
        """Number the tokens, and give each state its row: range edges, and the earliest turn at which an arc in the range left."""
        laid = defaultdict(list)  # on each token, what begins with it, newest first
        for w in sorted(self.left, key=self.born.__getitem__, reverse=True):
            laid[self.left[w]].append(w)
        self._number: dict[int, int] = {}
        ends: dict[int, int] = {}
        stack = [(t, False) for t in self.born if self.born[t] == -1]
        while stack:
            t, done = stack.pop()
            if done:
                ends[t] = len(self._number)
                continue
            self._number[t] = len(self._number)
            stack.append((t, True))
            stack += [(w, False) for w in reversed(laid[t])]
        ranges = defaultdict(list)
        for (u, v), turn in cut.items():
            # the arc v leaves, and with it what was laid on v in this turn (only where v is u) or later
            older = next((w for w in laid[v] if self.born[w] < turn), None)
            ranges[u].append((self._number[v], ends[v] if older is None else self._number[older], turn))
        self._rows: dict[int, tuple[array, array]] = {}
        for u, found in ranges.items():
            found.sort(key=lambda r: (r[0], -r[1]))
            edges, turns, open_ = array("i", [-1]), array("i", [_NEVER]), []

            def edge(at: int) -> None:
                while open_ and open_[-1][0] <= at:
                    end = open_.pop()[0]
                    put(end, open_[-1][1] if open_ else _NEVER)

            def put(at: int, turn: int, edges=edges, turns=turns) -> None:
                if edges[-1] == at:
                    turns[-1] = turn
                else:
                    edges.append(at)
                    turns.append(turn)

            for low, high, turn in found:  # ranges lie inside each other or apart
                edge(low)
                least = min(turn, open_[-1][1]) if open_ else turn
                open_.append((high, least))
                put(low, least)
            edge(_NEVER)
            self._rows[u] = edges, turns

    def _compile_bytes(self) -> None:
        """The trie of the labels of all tokens laid: (node, byte) -> node, and the tokens that end at each node, longest first."""
        steps: dict[int, int] = {}
        ends: list[tuple[tuple[int, int], ...]] = [()]
        for t in self.born:
            node = 0
            for b in self.labels[t]:
                node = steps.setdefault(node << 8 | b, len(steps) + 1)
                if node == len(ends):
                    ends.append(())
            ends[node] = ((t, len(self.labels[t])),)
        below = defaultdict(list)
        for key, node in steps.items():
            below[key >> 8].append((key & 255, node))
        back = [0] * len(ends)
        queue = deque([0])
        while queue:  # by depth, so that the fallback of a node is whole before the node
            at = queue.popleft()
            for b, node in below[at]:
                if at:
                    other = back[at]
                    while other and other << 8 | b not in steps:
                        other = back[other]
                    back[node] = steps.get(other << 8 | b, 0)
                ends[node] = ends[node] + ends[back[node]]
                queue.append(node)
        self._steps, self._back, self._ends = steps, back, ends

    def arc(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        number, rows, born, right, copied = self._number[b], self._rows, self.born, self.right, _NEVER
        while True:
            row = rows.get(a)
            if row is not None and row[1][bisect_right(row[0], number) - 1] < copied:
                return False
            copied = born[a]
            if copied == -1:
                return True
            a = right[a]

    def _walk(self, word: bytes, tokens: list[int], nodes: list[int]) -> tuple[int, ...]:
        """Ids of a word, of which the places so far (the token that ends each beginning, and its node) are known.

        The rest is read byte by byte, then the arcs are read from the end.
        """
        steps, back, ends, arcs = self._steps, self._back, self._ends, self._arcs
        node = nodes[-1]
        for at in range(len(tokens), len(word) + 1):
            b = word[at - 1]
            to = steps.get(node << 8 | b)
            while to is None:
                node = back[node]
                to = steps.get(node << 8 | b)
            node = to
            # each beginning of a word has one correct tokenization, so one token fits
            for t, size in ends[node]:
                if size == at:
                    break
                pair = tokens[at - size] << 24 | t
                there = arcs.get(pair)
                if there is None:
                    there = arcs[pair] = self.arc(pair >> 24, t)
                if there:
                    break
            tokens.append(t)
            nodes.append(node)
        out: list[int] = []
        at, labels = len(word), self.labels
        while at:
            t = tokens[at]
            out.append(t)
            at -= len(labels[t])
        return tuple(out[::-1])

    def word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-split word."""
        return self._walk(word, [-1], [0])

    def learn(self, words: set[str]) -> None:
        """Encode words and remember them; in order, each goes on where it leaves the one before."""
        if len(self._arcs) >= ARCS:
            self._arcs.clear()
        before, tokens, nodes = b"", [-1], [0]
        for raw, w in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            same, most = 0, min(len(before), len(raw))
            while same < most and before[same] == raw[same]:
                same += 1
            del tokens[same + 1 :], nodes[same + 1 :]
            self._words[w] = self._told(self._walk(raw, tokens, nodes))
            before = raw

    def odd(self, text: str) -> bool:
        """Whether a text has signs that Python's classes take differently (`odd_signs`), by one table for all its signs."""
        return bool(self._odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())

    def _told(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, bytes]:
        return ids, ",".join(map(str, ids)), b"".join(map(self.labels.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        """Control strings and pre-split words of a text in turn."""
        out: list[str] = []
        for part in self._control.split(text) if self._control else (text,):
            if part in self.control:
                out.append(part)
            else:
                out += (self._exact if self.odd(part) else self._plain).findall(part)
        return out

    def words(self, texts: list[str]) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """Of each text its words in turn: their ids, the same in decimal, and the labels that these ids emit.

        Words that are new to all texts are encoded together.
        """
        parts = [self.split(t) for t in texts]
        every = set().union(*parts) if parts else set()
        known = self._words
        new = every.difference(known)
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = every
        for w in new & self.control.keys():
            known[w] = self._told((self.control[w],))
        self.learn(new - self.control.keys())
        for words in parts:
            yield [known[w] for w in words]
        for w in new:
            if len(w) > 64:  # unlikely to come again
                del known[w]

    def encode(self, text: str) -> list[int]:
        return [i for told in self.words([text]) for ids, _, _ in told for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs in turn; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_compiled: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once in each Python process."""
    if path not in _compiled:
        _compiled[path] = Automaton(path)
    return _compiled[path]


def encoded(documents: DataFrame, path: str, lists: bool = True) -> DataFrame:
    """The documents with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids; columns of these names are replaced."""
    kept = documents.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    more += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if lists else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            n, digests, decoded, ids = [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for told in (w for x, z in slices([len(t) for t in texts], TOGETHER) for w in a.words(texts[x:z])):
                n.append(sum([len(ids) for ids, _, _ in told]))
                digests.append(hashlib.sha256(",".join([t for _, t, _ in told]).encode()).hexdigest())
                # bytes that are no UTF-8 become U+FFFD, as in `decode`
                decoded.append(hashlib.sha256(b"".join([b for _, _, b in told]).decode("utf-8", "replace").encode()).hexdigest())
                if lists:
                    ids.append([i for w, _, _ in told for i in w])
            new = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *([pa.array(ids, pa.list_(pa.int32()))] if lists else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in more)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *more]))
