"""Codes of vectors by small codebooks, found by vector-approximation filtering (operator 11).

A vector is cut into equal parts, and each part is coded by the nearest of up to 256 entries of that position's codebook.
The entries' coordinates are quantised by rank into CELLS cells a coordinate. A part under search makes two tables for
each coordinate, the least and the greatest squared difference to each cell; an entry's bounds are sums of what its cells
say there. An entry whose lower bound exceeds the smallest upper bound is out; those that overlap are refined with exact
integer distances, ties to the lower index.

Training is a pass over all vectors a round: tasks emit sums and counts of the entries they used, Spark adds them up, and
the driver gets at most parts * entries * width sums, whatever the number of vectors.

Defined results: null vectors and those with null or non-finite components are dropped; the width is that of the smallest
kept id's vector among lengths that the parts divide; kept vectors of another length have a null code and error; null ids
are coded but seed nothing; of repeated ids the smaller vector seeds first, each row is coded; components beyond
+-2 ** 100 count as that much, errors beyond a long as the greatest long; nothing to seed from gives no codebooks and null
codes; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells of a coordinate, and parts that are searched together.
CELLS, TOGETHER = 32, 1024
#: Labels whose sums are broadcast; more of them are joined by salted keys.
LABELS, SALTS = 100_000, 32
_FAR, _LONG = 1 << 100, (1 << 63) - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as longs, or as Python's integers where longs could not hold sums of them."""
    v = np.floor(x.astype(np.float64) * scale)
    if not v.size or np.abs(v).max() < 1 << 45:
        return v.astype(np.int64)
    return np.array([max(-_FAR, min(_FAR, int(c))) for c in v.ravel()], object).reshape(v.shape)


class Book:
    """One position's entries with their cells; `refined` counts the exact distances computed."""

    def __init__(self, entries: np.ndarray, cells: int = CELLS):
        n = len(entries)
        cells = min(cells, n)
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.entries, self.cell = entries, rank * cells // max(n, 1)
        ordered, edge = np.sort(entries, axis=0), -(-np.arange(cells + 1) * n // max(cells, 1))
        self.low, self.high = ordered[edge[:-1]], ordered[edge[1:] - 1]
        self.refined = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        reach = 2 * max(1, *(int(np.abs(v).max(initial=0)) for v in (x, self.entries)))
        most = reach * reach * max(1, x.shape[1])
        kind = np.int32 if most < 1 << 30 else np.int64 if most < 1 << 62 else object
        x, entries, low, high = (v.astype(kind) for v in (x, self.entries, self.low, self.high))
        index, error = np.zeros(len(x), np.int64), np.zeros(len(x), kind)
        for at in range(0, len(x), TOGETHER):
            q = np.ascontiguousarray(x[at : at + TOGETHER].T)
            least, greatest = (np.zeros((len(entries), q.shape[1]), kind) for _ in range(2))
            for c in range(len(q)):
                under, over = low[:, c, None] - q[c], q[c] - high[:, c, None]
                near = np.maximum(np.maximum(under, over), 0)
                far = np.maximum(q[c] - low[:, c, None], high[:, c, None] - q[c])
                least += (near * near)[self.cell[:, c]]
                greatest += (far * far)[self.cell[:, c]]
            entry, row = np.nonzero(least <= greatest.min(0))
            apart = entries[entry] - x[at + row]
            exact = np.full(least.shape, most + 1, kind)
            exact[entry, row] = (apart * apart).sum(1)
            self.refined += len(entry)
            index[at : at + TOGETHER] = exact.argmin(0)
            error[at : at + TOGETHER] = exact.min(0)
        return index, error


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, lengths, kept): the lists of a column, kept where neither they nor their components are missing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    there = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    return values, offsets[:-1], np.diff(offsets), there & (wrong[offsets[1:]] == wrong[offsets[:-1]])


def _matrix(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return values[starts[:, None] + np.arange(width)]


def _seeds(vectors: DataFrame, parts: int, n: int, width: int | None) -> np.ndarray:
    """The vectors of the n smallest ids: first of each task, then of groups of tasks, then of all. Nulls where lengths differ."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, tuple]] = []
        for b in batches:
            values, starts, lengths, kept = _vectors(b.column("embedding"))
            fits = kept & (lengths > 0) & (lengths % parts == 0) & (width is None or lengths == width)
            on = np.flatnonzero(fits & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False))
            ids = b.column("vec_id").take(pa.array(on)).to_numpy()
            if len(held) == n:
                on, ids = on[ids <= held[-1][0]], ids[ids <= held[-1][0]]
            if len(ids) > n:
                most = np.partition(ids, n - 1)[n - 1]
                on, ids = on[ids <= most], ids[ids <= most]
            held = sorted([*held, *((int(i), tuple(values[starts[k] : starts[k] + lengths[k]])) for i, k in zip(ids, on, strict=True))])[:n]
        if held:
            ids, rows = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([list(r) for r in rows], pa.list_(pa.float64()))], ["vec_id", "embedding"])

    schema = "vec_id long, embedding array<double>"
    first = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(smallest, schema)
    again = first.withColumn("at", F.spark_partition_id() % 64).repartition("at").select("vec_id", "embedding").mapInArrow(smallest, schema)
    rows = [r.embedding for r in again.orderBy("vec_id", "embedding").limit(n).collect()]
    if rows and any(len(r) != len(rows[0]) for r in rows):
        return _seeds(vectors, parts, n, len(rows[0]))
    return np.array(rows, np.float64)


def _moved(vectors: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """The codebooks after one round: each used entry is the floored mean of the parts nearest to it."""
    entries, w = books[0].shape
    width = w * len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, count = [Book(b) for b in books], np.zeros((len(books), entries, w), object), np.zeros((len(books), entries), np.int64)
        for b in batches:
            values, starts, lengths, kept = _vectors(b.column("embedding"))
            x = whole(_matrix(values, starts[kept & (lengths == width)], width), scale)
            for p, book in enumerate(held):
                part = x[:, p * w : (p + 1) * w]
                code, _ = book.nearest(part)
                used, start, n = np.unique(np.sort(code), return_index=True, return_counts=True)
                if len(used):
                    total[p, used] += np.add.reduceat(part[np.argsort(code, kind="stable")], start, axis=0).astype(object)
                    count[p, used] += n
        p, e = np.nonzero(count)
        cell = ((p * entries + e)[:, None] * w + np.arange(w)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.repeat(count[p, e], w)), pa.array([Decimal(int(v)) for v in total[p, e].ravel()], pa.decimal128(38, 0))], ["cell", "n", "s"])

    got = vectors.select("embedding").mapInArrow(sums, "cell long, n long, s decimal(38,0)").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    new = np.stack(books).astype(object)
    flat = new.reshape(-1)
    for r in got:
        flat[r.cell] = int(r.s) // r.n
    return [b.astype(np.int64) if int(np.abs(b).max(initial=0)) < 1 << 45 else b for b in new]


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The trained codebook of each part position (none where no vector can seed one)."""
    seeds = whole(_seeds(vectors, parts, entries, None), scale)
    if not len(seeds):
        return []
    books = np.split(seeds, parts, axis=1)
    for _ in range(rounds):
        books = _moved(vectors, books, scale)
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def coded(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of each vector that takes part."""
    width = sum(b.shape[1] for b in books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Book(b) for b in books]
        for b in batches:
            values, starts, lengths, kept = _vectors(b.column("embedding"))
            rows = np.flatnonzero(kept)
            fits = np.flatnonzero(lengths[rows] == width) if books else rows[:0]
            x = whole(_matrix(values, starts[rows[fits]], width), scale)
            code, error = np.zeros((len(fits), len(held)), np.uint8), np.zeros(len(fits), object)
            for p, (book, part) in enumerate(zip(held, np.split(x, max(1, len(held)), axis=1))):
                at, apart = book.nearest(part)
                code[:, p], error = at, error + apart.astype(object)
            texts, errors = np.full(len(rows), None, object), np.full(len(rows), None, object)
            texts[fits], errors[fits] = [bytes(c).hex() for c in code], [min(int(e), _LONG) for e in error]
            some = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    rows = vectors.select("vec_id", "label", "embedding")
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {kind}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """The rows with `label_error`, the error summed over equal labels (nulls together, at most the greatest long)."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LONG))).cast("long")
    totals = rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    if totals.limit(LABELS + 1).count() <= LABELS:
        return rows.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    # a frequent label is spread over SALTS keys
    spread = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")), "left").drop("of", "own", "salt")


def report(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that takes part."""
    books = codebooks(vectors, parts, entries, rounds, scale)
    rows = with_label_error(materialize(coded(vectors, books, scale)))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
