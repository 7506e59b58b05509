"""Exact top-k inner products by norm-bucketed retrieval (operator 5).

Vectors are grouped by length into at most LAYERS layers, and a layer is dealt into buckets of a bounded size. A first
round over the longest vectors gives each query a threshold, its k-th best product so far. The layers that cannot reach
it (length of the query times the layer's greatest length) are passed over before anything is shuffled: queries with like
thresholds share a block, a block travels to the buckets of its live layers alone, and a bucket to the blocks that want
it. Within a bucket each query has its own local cosine threshold: a high one prunes by a coordinate (on the query's
heaviest coordinate a candidate must lie in the interval that the threshold allows), a low one by length. What is left
is verified by whole products.

Defined results: null vectors, empty ones and those with null or non-finite components take no part, nor do null ids;
shorter vectors count as padded with zeros; a repeated vec_id is a candidate of its own, but never of a query with its
id; a repeated query row has each of its hits again, as in the SQL; ties go to the smaller vec_id; an empty table gives
an empty result; further columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, STEPS, EVERY = 5, 256, 50
#: Vectors in a bucket and queries in a block, on average, and longest vectors that give the first thresholds.
BUCKET, BLOCK, FIRST = 8192, 4096, 512
#: Most layers of length; a bound of what the driver gets and broadcasts (a few numbers each).
LAYERS = 256
#: A local cosine threshold from which a coordinate prunes more than it costs.
STEEP = 0.6
#: Queries whose products are computed together.
TOGETHER = 64
_HITS = "query_id long, vec_id long, score long"


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where all sums are under 2 ** 53, else in longs."""
    most = (np.abs(q).max(initial=0).astype(float) * np.abs(p).max(initial=0).astype(float)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    return np.stack([(p * row).sum(1) for row in q])


def _square(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows), default=0)
    return np.stack([np.pad(np.asarray(v, np.int64), (0, width - len(v))) for v in rows]) if len(rows) else np.zeros((0, 0), np.int64)


class Bucket:
    """The vectors of a bucket, longest first, with unit coordinates sorted when a query asks for one."""

    def __init__(self, ids: np.ndarray, p: np.ndarray):
        norms = np.sqrt((p.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norms))
        self.ids, self.p, self.norms = ids[order], p[order], norms[order]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The f-th coordinates of the unit vectors in rising order, and whose they are."""
        if f not in self._sorted:
            x = self.p[:, f] / np.where(self.norms > 0, self.norms, 1)
            order = np.argsort(x, kind="stable")
            self._sorted[f] = x[order], order
        return self._sorted[f]

    def candidates(self, q: np.ndarray, length: float, floor: float) -> np.ndarray | int:
        """Who can reach the floor: the first so many by length, or the numbers of those whose coordinate allows it."""
        if floor <= 0 or not len(self.norms):
            return len(self.norms)
        most = length * self.norms[0]
        local = floor / most if most > 0 else np.inf
        if local > 1 + 1e-9:
            return 0
        far = int(np.searchsorted(-self.norms, -(floor / length) * (1 - 1e-9), side="right"))
        if local <= STEEP:
            return far
        f = int(np.abs(q).argmax())
        middle, reach = np.arccos(np.clip(q[f] / length, -1, 1)), np.arccos(min(1.0, local))
        x, order = self.coordinate(f)
        low, high = np.searchsorted(x, [np.cos(min(np.pi, middle + reach)) - 1e-7, np.cos(max(0.0, middle - reach)) + 1e-7])
        if high - low >= far:
            return far
        some = order[low:high]
        return np.sort(some[some < far])


def search(queries: pd.DataFrame, bucket: pd.DataFrame, k: int, done: list | None = None) -> pd.DataFrame:
    """The k best of one bucket for each query (columns id, v, floor): products below the query's floor are not sought.

    `done` gets the number of products computed, in tests.
    """
    q, p = _square(queries["v"]), _square(bucket["v"])
    width = max(q.shape[1], p.shape[1])
    q, p = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, p))
    b = Bucket(bucket["id"].to_numpy(np.int64), p)
    own, floor = queries["id"].to_numpy(np.int64), queries["floor"].to_numpy(np.float64)
    lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    out, by_length = [], []

    def keep(row: int, near: np.ndarray, score: np.ndarray) -> None:
        on = np.flatnonzero((b.ids[near] != own[row]) & (score >= floor[row]))
        if len(on) > 4 * k:
            on = on[score[on] >= np.partition(score[on], len(on) - k)[len(on) - k]]
        on = on[np.lexsort((b.ids[near[on]], -score[on]))][:k]
        out.append((np.full(len(on), own[row]), b.ids[near[on]], score[on]))

    for row in range(len(q)):
        found = b.candidates(q[row], lengths[row], floor[row])
        if isinstance(found, int):
            if found:
                by_length.append((found, row))
        elif len(found):
            keep(row, found, _products(q[row : row + 1], b.p[found])[0])
            if done is not None:
                done.append(len(found))
    by_length.sort()
    for at in range(0, len(by_length), TOGETHER):
        # queries of like reach are multiplied together
        rows = [row for _, row in by_length[at : at + TOGETHER]]
        most = by_length[min(at + TOGETHER, len(by_length)) - 1][0]
        score = _products(q[rows], b.p[:most])
        for row, each in zip(rows, score, strict=True):
            keep(row, np.arange(most), each)
        if done is not None:
            done.append(score.size)
    columns = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _usable(vectors: DataFrame, steps: int, id_column: str, column: str) -> DataFrame:
    """(id, v, norm): the rows that take part, in whole steps, with their lengths."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(steps)) * v.cast("double")).cast("long")).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def _layered(rows: DataFrame, layers: int) -> DataFrame:
    """The rows with `layer`, 0 for the longest: shares of about equal size by at most LAYERS - 1 edges."""
    edges = sorted(set(rows.approxQuantile("norm", [1 - b / layers for b in range(1, layers)], min(0.01, 0.25 / layers)))) if layers > 1 else []
    if not edges:
        return rows.withColumn("layer", F.lit(0))
    return rows.withColumn("layer", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col("norm"))))


def _thresholds(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The queries with `floor`, the k-th best product with the longest vectors (no floor where there are fewer)."""
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    longest = rows.orderBy(F.desc("norm"), "id").limit(FIRST)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = longest.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).toDF("id", "v", "block")
    start = dealt.groupBy("block").cogroup(every.groupBy("block"))
    first = _best(start.applyInPandas(lambda q, b: search(q.assign(floor=-np.inf), b, k), _HITS), k)
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    return queries.join(floors.withColumnRenamed("query_id", "id"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))


def live_pairs(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, block, id, v, floor) of queries and (bucket, block, id, v) of vectors: what meets, after layers out of reach are passed over.

    rows come with `layer`, queries with `norm` and `floor`; both are read more than once, so they should be materialized.
    """
    spark = rows.sparkSession
    layers = [(r.layer, r.most, max(1, math.ceil(r.n / BUCKET))) for r in rows.groupBy("layer").agg(F.max("norm").alias("most"), F.count("*").alias("n")).orderBy("layer").collect()]  # at most LAYERS rows
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in layers])]).astype(int).tolist()
    # the last layer that a query's threshold allows; queries are dealt into blocks in its order
    reach = F.sequence(F.lit(0), F.lit(len(layers) - 1))
    greatest = F.array(*[F.lit(float(most)) for _, most, _ in layers]) if layers else F.array().cast("array<double>")
    allowed = lambda at: F.col("norm") * F.element_at(greatest, at + 1) * (1 + 1e-9) >= F.col("floor")
    lives = F.coalesce(F.array_max(F.filter(reach, allowed)), F.lit(-1)).alias("last")
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    ranged = queries.select("id", "v", "floor", lives).filter("last >= 0").repartitionByRange(blocks, F.desc("last"), "id")
    # partitions in a row make up a block, should there be more of them than blocks
    parts = max(1, ranged.rdd.getNumPartitions())
    dealt = materialize(ranged.withColumn("block", F.floor(F.spark_partition_id() * F.lit(min(blocks, parts)) / F.lit(parts)).cast("int")))
    # blocks go by falling reach, so the blocks that want a layer are the first ones
    wanted = {r["last"]: r.block for r in dealt.groupBy("last").agg(F.max("block").alias("block")).collect()}  # at most LAYERS rows
    table = [(layer, starts[i], n, max((b for last, b in wanted.items() if last >= i), default=-1)) for i, (layer, _, n) in enumerate(layers)]
    known = F.broadcast(spark.createDataFrame(table, "layer int, start int, buckets int, blocks int"))
    of_layer = rows.join(known, "layer").filter("blocks >= 0")
    vectors = of_layer.select((F.col("start") + F.pmod(F.monotonically_increasing_id(), F.col("buckets"))).cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("block"), "id", "v").toDF("bucket", "block", "id", "v")
    ends = F.array(*map(F.lit, starts[1:])) if layers else F.array().cast("array<int>")
    sides = dealt.select(F.explode(F.sequence(F.lit(0), F.element_at(ends, F.col("last") + 1) - 1)).alias("bucket"), "block", "id", "v", "floor").toDF("bucket", "block", "id", "v", "floor")
    return sides, vectors


def top_k(vectors: DataFrame, k: int = K, steps: int = STEPS, every: int = EVERY, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, the k other rows of the largest product of floor(steps * x)."""
    rows = materialize(_usable(vectors, steps, id_column, column))
    layers = min(LAYERS, max(1, math.ceil(rows.count() / BUCKET)))
    queries = materialize(_thresholds(rows, rows.filter(F.col("id") % every == 0), k))
    q, p = live_pairs(_layered(rows, layers), queries)
    pairs = q.groupBy("bucket", "block").cogroup(p.groupBy("bucket", "block"))
    return _best(pairs.applyInPandas(lambda q, b: search(q, b, k), _HITS), k).select("query_id", "rank", "vec_id", "score")
