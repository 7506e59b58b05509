"""Connected components of a link table by alternating large-star and small-star steps, one shuffle a step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node u links its larger (or smaller and own) neighbours to the least of its neighbourhood."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    kept = met.filter(F.col("v") > F.col("u")) if large else met
    out = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; links has columns u and v of one type.

    Links to itself and repeated links do not matter; an empty table gives an empty one. No hub meets in one task as
    rows only: least values are combined before the shuffle, and joins on a hub are left to adaptive skew handling.
    """
    edges = materialize(links.filter("u <> v").select("u", "v").distinct())
    while True:
        n = edges.count()
        if n == 0:
            break
        after = materialize(_star(_star(edges, True), False))
        same = after.count() == n and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(label[label], label):
            label = label[label]
