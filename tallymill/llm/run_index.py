"""Exact removal of repeated byte strings with a run-length Burrows-Wheeler index (operator 1).

Every `length`-byte string of a text is routed by the smallest hash of its 32-byte pieces, so equal strings meet. A
first pass counts these keys; only stretches whose key occurs again travel on. In each bucket the runs of the
Burrows-Wheeler transform of its stretches are found, and the suffix array is kept at the ends of runs alone, with what
neighbouring suffixes share there; from those samples the matching statistics of every position are streamed, and
strings that also start earlier are marked. The symbols of the runs are not kept: the statistics need only their ends.

Texts are shuffled by group of documents, once for counting and once for the rest; first copies of whole texts, keys
and spans travel to them as narrow rows.

Defined results: a null text is the empty text; rows that repeat a doc_id with the same text get the same answer, with
different texts they count in the order of the texts' hash; a null doc_id comes before all others. Texts under
`length` bytes are never cut. Further columns of the input pass through `dedup` unchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, total_bytes

LENGTH = 100
PIECE = 32
#: Bytes of text in one group of documents and in one index, on average; their numbers grow with the input.
GROUP_BYTES, INDEX_BYTES = 8 << 20, 3 << 20
#: A key whose stretches would fill an index alone is dealt out by whole strings instead.
HOT_KEY = INDEX_BYTES // 128
#: Kind of a side row that names a first copy; 0 is a key, 1 a hot key, 2 a whole string of a hot key.
FIRST = 3
_SPANS = "g long, id long, h long, s long, e long"


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _combine(h: np.ndarray, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h[:-shift] * np.uint64(0x9FB21C651E98DF25) + h[shift:]
        return h ^ (h >> np.uint64(28))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    step, reach = h, 1
    while reach * 2 <= width:
        step, reach = np.minimum(step[:-reach], step[reach:]), reach * 2
    return step if reach == width else np.minimum(step[: len(step) - (width - reach)], step[width - reach :])


def stretches(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first string, last string and occurrences (1, or 2 for more) of the key's piece, for each run of strings with one key."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none.astype(np.uint64), none, none, none
    h, reach = _table()[np.frombuffer(text, np.uint8)], 1
    while reach < PIECE:
        h, reach = _combine(h, reach), reach * 2
    width = length - PIECE + 1
    key = _sliding_min(h, width)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(key) - 1]])
    runs = key[first]
    near = np.lib.stride_tricks.sliding_window_view(h, width)
    times = np.empty(len(first), np.int64)
    for at in range(0, len(first), 1 << 14):
        part = slice(at, at + (1 << 14))
        begins = first[part] + np.argmax(near[first[part]] == runs[part, None], 1)
        stops = last[part] + width - 1 - np.argmax(near[last[part]][:, ::-1] == runs[part, None], 1)
        times[part] = 1 + (begins != stops)
    return runs, first, last, times


def _whole_hashes(text: bytes, length: int) -> np.ndarray:
    """A 64-bit hash of every string of `length` bytes, by powers of two."""
    h, reach = _table()[np.frombuffer(text, np.uint8)], 1
    out, done = None, 0
    while True:
        if length & reach:
            n = len(text) - length + 1
            part = h[done : done + n]
            with np.errstate(over="ignore"):
                out, done = part if out is None else mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + part), done + reach
        if done == length:
            return out
        h, reach = _combine(h, reach), reach * 2


class RunIndex:
    """Run-length BWT of segments, with the suffix array sampled at the ends of runs."""

    def __init__(self, segments: list[bytes]):
        sizes = np.array([len(s) + 1 for s in segments], np.int64)
        self.ends = np.cumsum(sizes)
        self.text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int16) + 1
        self.text[self.ends - 1] = 0
        n = len(self.text)
        packed, stop = np.zeros(n, np.int64), np.zeros(n, bool)
        for t in range(7):
            at = np.zeros(n, np.int64)
            at[: n - t] = self.text[t:]
            stop |= at == 0
            packed = packed << 9 | np.where(stop, 0, at)
        order = self._sort(packed, stop)
        ahead = self.text[order - 1]
        head = np.concatenate([[True], ahead[1:] != ahead[:-1]]) | (ahead == 0)
        starts = np.flatnonzero(head)[1:]
        at, before = order[starts], order[starts - 1]
        shared = self._shared(at, before, packed, stop)
        by_place = np.argsort(at)
        # the last suffix of a run and the first of the next one, with what they share
        self.sample_at, self.sample_before, self.sample_shared = at[by_place], before[by_place], shared[by_place]

    @staticmethod
    def _sort(packed: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; separators differ from each other and rank by place."""
        n = len(packed)
        order = np.argsort(packed, kind="stable")
        fresh = np.concatenate([[True], (packed[order[1:]] != packed[order[:-1]]) | stop[order[1:]]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        reach = 7
        while True:
            alone = fresh & np.concatenate([fresh[1:], [True]])
            left = order[~alone]
            if not len(left):
                break
            joint = rank[left] << 32 | rank[np.minimum(left + reach, n - 1)]
            sub = np.argsort(joint)
            joint, left = joint[sub], left[sub]
            new = np.concatenate([[True], joint[1:] != joint[:-1]])
            order[np.flatnonzero(~alone)] = left
            places = np.flatnonzero(~alone)
            fresh[places] = new
            rank[left] = np.maximum.accumulate(np.where(new, places, 0))
            reach *= 2
        return order

    def _shared(self, a: np.ndarray, b: np.ndarray, packed: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            live = live[(packed[x] == packed[y]) & ~stop[x]]
            out[live] += 7
        live = np.arange(len(a))
        while len(live):
            x, y = self.text[a[live] + out[live]], self.text[b[live] + out[live]]
            live = live[(x == y) & (x > 0)]
            out[live] += 1
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position the place of the preceding suffix in suffix order, and the bytes that both share."""
        where = np.arange(len(self.text))
        k = np.searchsorted(self.sample_at, where, side="right") - 1
        ahead = where - self.sample_at[k]
        before, shared = self.sample_before[k] + ahead, self.sample_shared[k] - ahead
        shared[k < 0] = 0
        return before, np.maximum(shared, 0)

    def repeats(self, length: int) -> np.ndarray:
        """True at each position whose next `length` bytes also start at an earlier position."""
        before, shared = self.statistics()
        where = np.arange(len(self.text))
        up = np.where(shared >= length, before, where)
        while True:
            further = up[up]
            if np.array_equal(further, up):
                break
            up = further
        first = where.copy()
        np.minimum.at(first, up, where)
        return first[up] < where


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[tuple[int, int]] = []
    for s, e in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist() if len(spans) else ():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _first_copies(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
    """The documents of a group that are first copies of their texts, once each; `side` names them by kind FIRST."""
    return docs.merge(side[side["kind"] == FIRST][["id", "h"]], on=["id", "h"]).drop_duplicates(["id", "h"])


def _count(length: int, whole: bool):
    """Keys of a group of documents and how many stretches have them; if whole, the strings of stretches with a hot key."""

    def count(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        found, times = [], []
        chosen = np.sort(side.loc[side["kind"] == 1, "key"].to_numpy(np.int64).view(np.uint64))
        for text in _first_copies(docs, side)["t"] if len(chosen) or not whole else ():
            keys, first, last, n = stretches(text, length)
            if whole:
                on = np.flatnonzero(_member(keys, chosen))
                if len(on):
                    h = _whole_hashes(text, length)
                    keys = np.concatenate([h[first[k] : last[k] + 1] for k in on])
                    n = np.ones(len(keys), np.int64)
                else:
                    keys, n = keys[:0], n[:0]
            found.append(keys)
            times.append(n)
        if not found:
            return pd.DataFrame({"key": [], "g": [], "n": []}).astype(np.int64)
        keys, back = np.unique(np.concatenate(found), return_inverse=True)
        return pd.DataFrame({"key": keys.view(np.int64), "g": docs["g"].iloc[0], "n": np.bincount(back, np.concatenate(times), len(keys)).astype(np.int64)})

    return count


def _repeated(counts: DataFrame) -> DataFrame:
    """(g, key, n): the groups of each key that occurs at least twice in the corpus; a key's rows stay rows, however many."""
    every = counts.withColumn("n", F.sum("n").over(Window.partitionBy("key")))
    return every.filter("n > 1").select("g", "key", "n")


def _send(length: int, buckets: int):
    """The stretches of a group that can repeat: the first copy of each goes to its bucket, later ones are spans already."""

    def of(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        out, seen = [], set()
        plain, hot, strings = (np.sort(side.loc[side["kind"] == kind, "key"].to_numpy(np.int64).view(np.uint64)) for kind in (0, 1, 2))
        for r in _first_copies(docs, side).sort_values(["id", "h"]).itertuples() if len(plain) or len(hot) else ():
            runs, first, last, _ = stretches(r.t, length)
            parts = [(int(runs[k]), int(first[k]), int(last[k])) for k in np.flatnonzero(_member(runs, plain))]
            if len(hot) and len(on := np.flatnonzero(_member(runs, hot))):
                h = _whole_hashes(r.t, length)
                at = np.concatenate([np.arange(first[k], last[k] + 1) for k in on])
                parts += [(int(h[x]), int(x), int(x)) for x in at[_member(h[at], strings)]]
            for key, a, b in sorted(parts, key=lambda p: p[1]):
                segment = r.t[a : b + length]
                if segment in seen:
                    out.append((r.g, r.id, r.h, a, b + length, r.g % buckets, None))
                else:
                    seen.add(segment)
                    out.append((r.g, r.id, r.h, a, 0, key % buckets, segment))
        return pd.DataFrame(out, columns=["g", "id", "h", "s", "e", "bucket", "segment"])

    return of


def _mark(length: int):
    """Index one bucket and give back the spans of its strings that start earlier too."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        done = rows[rows["segment"].isna()][["g", "id", "h", "s", "e"]]
        rows = rows[rows["segment"].notna()].sort_values(["id", "h", "s"], kind="stable")
        if not len(rows):
            return done
        # a stretch that stands whole in an earlier place is covered, and its earlier copy answers for it in the index
        copy = rows["segment"].duplicated()
        same = rows[copy]
        done = pd.concat([done, same[["g", "id", "h", "s"]].assign(e=same["s"] + same["segment"].map(len))])
        rows = rows[~copy]
        index = RunIndex(rows["segment"].tolist())
        again = index.repeats(length)
        edge = np.flatnonzero(np.diff(again.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        a, b = edge[::2], edge[1::2] - 1
        of_segment = np.searchsorted(index.ends, a, side="right")
        base = rows["s"].to_numpy(np.int64)[of_segment] - np.concatenate([[0], index.ends[:-1]])[of_segment]
        found = rows[["g", "id", "h"]].iloc[of_segment].reset_index(drop=True)
        return pd.concat([done, found.assign(s=a + base, e=b + base + length)])

    return of


def _finish(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
    by = {k: x[["s", "e"]].to_numpy(np.int64) for k, x in side[side["kind"] != FIRST].groupby(["id", "h"])}
    out = []
    for r in _first_copies(docs, side).itertuples():
        cut = merged(by.get((r.id, r.h), np.zeros((0, 2), np.int64)))
        out.append((r.id, r.h, [s for s, _ in cut], [e for _, e in cut], hashlib.sha256(_kept(r.t, cut)).hexdigest()))
    return pd.DataFrame(out, columns=["id", "h", "starts", "ends", "kept_sha256"])


def removals(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row (id, h, starts, ends, kept_sha256) for each different (doc_id, text) that is the first copy of a text of `length` bytes or more.

    id is doc_id with nulls as the smallest long, h a hash of the text.
    """
    if length < PIECE:
        raise ValueError(f"length is {PIECE} or more")
    rows = documents.select(_id().alias("id"), _bytes().alias("t")).withColumn("h", F.xxhash64("t"))
    long = rows.filter(F.octet_length("t") >= length)
    volume = total_bytes(long, "t")
    groups, buckets = max(1, math.ceil(volume / GROUP_BYTES)), max(1, math.ceil(volume / INDEX_BYTES))
    group, none = F.pmod(F.xxhash64("id", "h"), F.lit(groups)), F.lit(0).cast("long")
    # later copies of a whole text are covered by the first one, so only first copies are searched
    first = long.groupBy(F.sha2("t", 256).alias("digest")).agg(F.min(F.struct("id", "h")).alias("m")).select("m.id", "m.h").distinct()
    first = materialize(first.withColumns({"g": group, "key": none, "kind": F.lit(FIRST)}))
    by_group = long.withColumn("g", group).repartition(groups, "g").groupBy("g")
    beside = lambda keys: first.unionByName(keys.withColumns({"id": none, "h": none}).select(*first.columns)).groupBy("g")
    counts = by_group.cogroup(first.groupBy("g")).applyInPandas(_count(length, False), "key long, g long, n long")
    keys = materialize(_repeated(counts).withColumn("kind", (F.col("n") > HOT_KEY).cast("int")))
    hot = keys.filter("kind = 1")
    if not hot.isEmpty():
        finer = by_group.cogroup(beside(hot)).applyInPandas(_count(length, True), "key long, g long, n long")
        keys = keys.unionByName(_repeated(finer).withColumn("kind", F.lit(2)))
    sent = by_group.cogroup(beside(keys)).applyInPandas(_send(length, buckets), f"{_SPANS}, bucket long, segment binary")
    spans = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_mark(length), _SPANS).withColumn("kind", F.lit(0))
    marks = spans.unionByName(first.select("g", "id", "h", none.alias("s"), none.alias("e"), "kind"))
    return by_group.cogroup(marks.groupBy("g")).applyInPandas(_finish, "id long, h long, starts array<long>, ends array<long>, kept_sha256 string")


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _bytes() -> F.Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def report(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (byte spans removed)."""
    found = removals(documents, length)
    n = F.octet_length("t").cast("long")
    docs = documents.select("doc_id", _id().alias("id"), _bytes().alias("t")).select("doc_id", "id", F.xxhash64("t").alias("h"), n.alias("n_bytes"), F.sha2("t", 256).alias("own"))
    short, none = F.col("n_bytes") < length, F.array().cast("array<long>")
    searched = F.col("starts").isNotNull()
    starts = F.when(searched, F.col("starts")).when(short, none).otherwise(F.array(F.lit(0).cast("long")))
    ends = F.when(searched, F.col("ends")).when(short, none).otherwise(F.array(F.col("n_bytes")))
    out = docs.join(found, ["id", "h"], "left").withColumns({"starts": starts, "ends": ends})
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    sha = F.when(short, F.col("own")).otherwise(F.coalesce("kept_sha256", F.sha2(F.lit(b""), 256)))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), sha.alias("kept_sha256"), "starts", "ends", "h")


def _cut_texts(starts: str, ends: str, emptied: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = []
            for text, a, b in zip(rows["text"], rows.pop(starts), rows.pop(ends), strict=True):
                if text is None or a is None or not len(a):
                    texts.append(text)
                    continue
                raw = text.encode()
                # whole characters go; one that is only partly covered stays
                inward = lambda k, step: k if k <= 0 or k >= len(raw) or raw[k] & 0xC0 != 0x80 else inward(k + step, step)
                spans = [(inward(int(s), 1), inward(int(e), -1)) for s, e in zip(a, b, strict=True)]
                texts.append(_kept(raw, [(s, e) for s, e in spans if s < e]).decode())
            had = rows["text"].map(bool)
            out = rows.assign(text=texts)
            yield out if emptied else out[~had | out["text"].map(bool)]

    return run


def dedup(documents: DataFrame, length: int = LENGTH, emptied: bool = True) -> DataFrame:
    """The documents with repeated strings cut from their texts (whole characters); all columns stay.

    Documents that lose all their text stay with an empty one, unless `emptied` is false.
    """
    mark = "__cut"
    while any(c.startswith(mark) for c in documents.columns):  # names of the input are its own
        mark = f"_{mark}"
    key, h, starts, ends = (f"{mark}_{x}" for x in ("id", "h", "starts", "ends"))
    found = report(documents, length).filter(F.size("starts") > 0)
    spans = found.select(_id().alias(key), F.col("h").alias(h), F.col("starts").alias(starts), F.col("ends").alias(ends)).dropDuplicates([key, h])
    joined = documents.join(spans, (_id() == F.col(key)) & (F.xxhash64(_bytes()) == F.col(h)), "left").drop(key, h)
    return joined.mapInPandas(_cut_texts(starts, ends, emptied), documents.schema)
