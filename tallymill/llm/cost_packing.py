"""Cost-balanced packing of token sequences (operator 9).

A document's tokens cost a linear share and a quadratic one (attention). Documents that arrive at a task are packed in
bins of bounded total size: cut into whole sequences first, then, from the longest rest to the shortest, each goes to
the sequence of the lowest cost that still has room; where none has, it is cut to fill the roomiest. The sequences
opened hold exactly the tokens there are: full ones and one of each power of two in the remainder, so nothing is padded.
There is no shuffle: every task packs its own documents, and sequence ids begin with the partition's number.

Defined results: a null or empty text is the end token alone; repeated rows are documents of their own; ties go to the
lower sequence and, among documents of one size, to the first that arrives; further columns do not matter.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_odd
from .merge_automaton import byte_letters

CAPACITY, END = 4096, 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens packed at once in a task.
BIN_TOKENS = 1 << 21
#: Words a Python worker remembers; beyond that it starts anew.
MEMORY = 150_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: How the vocabulary's tokenizer splits a lower-cased text, in Python's own classes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"


class WordTokens:
    """Ids of a text, as bytes of little-endian 32-bit numbers, by the tokenizer's answer for each of its words.

    A text is asked for whole where its words cannot be told apart safely: control strings, forms that normalization
    changes, a capital sigma, or signs that Python's classes take differently.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.split = re.compile(SPLIT)
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(self.known) >= MEMORY:
            self.known.clear()
        mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = self.known[word] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        low = text.lower()
        if "<|" in text or "\u03a3" in text or not unicodedata.is_normalized("NFC", text) or has_odd(low):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, get = self.split.findall(low), self.known.get
        return b"".join([get(w) or self._word(w) for w in words])


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def pack(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset), and the length of each sequence."""
    out, lengths, rests = [], [], []
    for d, n in enumerate(sizes):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, len(lengths), 0))
            lengths.append(capacity)
        if n % capacity:
            rests.append((n % capacity, d, whole * capacity))
    total, first = sum(r[0] for r in rests), len(lengths)
    lengths += [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> k & 1]
    room = np.array(lengths[first:], np.int64)
    spent = np.zeros(len(room))
    for n, d, start in sorted(rests, key=lambda r: -r[0]):
        while n:
            fits = room >= n
            at = int(np.where(fits, spent, np.inf).argmin()) if fits.any() else int(room.argmax())
            part = min(n, int(room[at]))
            out.append((d, start, part, first + at, lengths[first + at] - int(room[at])))
            room[at] -= part
            spent[at] += cost(part)
            n, start = n - part, start + part
    return out, lengths


def packed(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity is a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, base = WordTokens(path), TaskContext.get().partitionId() << 36
        docs: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            sizes = [len(x) // 4 for x in ids]
            pieces, lengths = pack(sizes, capacity)
            rows = [(docs[d], s, n, zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]), sizes[d], base + q, o) for d, s, n, q, o in pieces]
            base += len(lengths)
            docs.clear()
            ids.clear()
            held = 0
            names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=names)

        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                docs.extend(part.column(0).to_pylist())
                got = [words.ids(t or "") + end for t in part.column(1).to_pylist()]
                ids.extend(got)
                held += sum(map(len, got)) // 4
                if held >= BIN_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
