"""Running values along keys of any length: a key's rows are cut into stretches, and each stretch starts from what those before it say.

A window over a whole key is one task's work. Here a task holds a stretch; what is carried from stretch to stretch is one
row for each, so only these few rows meet by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH, PARTS = "stretch", 64
_BEFORE = (Window.unboundedPreceding, -1)


def _of_stretch(kind: str, value: Column, order: str) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
    if kind == "first":
        return F.min_by(value, F.when(value.isNotNull(), F.col(order)))
    return F.max(value) if kind == "max" else F.sum(value)


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    if kind == "first":
        return F.first(value, ignorenulls=True).over(window)
    return F.max(value).over(window) if kind == "max" else F.sum(value).over(window)


def _both(kind: str, here: Column, carried: Column) -> Column:
    if kind == "max":
        return F.greatest(here, carried)
    if kind == "sum":
        return F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return F.coalesce(here, carried) if kind == "last" else F.coalesce(carried, here)


def alike(names: tuple[str, ...]) -> Column:
    """Columns that equal those of the same name with `of_` before it, nulls too."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in names))


def met(rows: DataFrame, few: DataFrame, key: tuple[str, ...], by: str, how: str) -> DataFrame:
    """Rows joined with the one row of their key (null keys too); a key's rows are dealt to parts by a column first, so that no task has all of them."""
    every = few.select(*[F.col(c).alias(f"of_{c}") for c in key], *[c for c in few.columns if c not in key], F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("of_part"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    return dealt.join(every, alike((*key, "part")), how).drop("part", "of_part", *[f"of_{c}" for c in key])


def along(rows: DataFrame, key: tuple[str, ...], order: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows with, for each name, the last or first known value, the greatest or the sum of all rows of the key up to this one.

    Kinds are last, first, max and sum; with _before the row itself is left out; `total` is the sum over the whole key.
    Rows have `stretch`, a number that never falls as `order` grows, and no two rows of a key share an `order`. The rows
    are read twice, so they should be stored; null keys are a key.
    """
    kinds = {n: (k.removesuffix("_before").replace("total", "sum"), k) for n, (k, _) in values.items()}
    groups = (*key, STRETCH)
    per = rows.groupBy(*groups).agg(*[_of_stretch(kinds[n][0], v, order).alias(f"per_{n}") for n, (_, v) in values.items()])
    chain, whole = Window.partitionBy(*key).orderBy(STRETCH).rowsBetween(*_BEFORE), Window.partitionBy(*key)
    carried = per.select(
        *[F.col(c).alias(f"of_{c}") for c in groups],
        *[_over(kinds[n][0], F.col(f"per_{n}"), whole if kinds[n][1] == "total" else chain).alias(f"carried_{n}") for n in values],
    )
    rows = rows.join(carried, alike(groups))
    here = Window.partitionBy(*groups).orderBy(order)
    out = {}
    for name, (_, value) in values.items():
        kind, full = kinds[name]
        window = here.rowsBetween(*(_BEFORE if full.endswith("_before") else (Window.unboundedPreceding, 0)))
        out[name] = F.col(f"carried_{name}") if full == "total" else _both(kind, _over(kind, value, window), F.col(f"carried_{name}"))
    return rows.withColumns(out).drop(*[f"of_{c}" for c in groups], *[f"carried_{n}" for n in values])
