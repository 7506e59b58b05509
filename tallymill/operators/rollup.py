"""Time, session and price rollups as one pass over events each, mergeable and retractable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.measures import METRICS, calculable, merged_metrics, metric_aggregates, price_basis, price_tier

MINUTE, HOUR = 60, 3600
NANOS = 1_000_000_000
_MOMENT = "decimal(30,0)"
TIME_KEYS = ("bucket_width", "bucket_start", "provider_id", "profile_id", "dimension", "dimension_value")
SESSION_KEYS = ("provider_id", "profile_id", "session_id", "dimension", "dimension_value")


def bucket(seconds: Column, width: Column | int) -> Column:
    """Start of the bucket, for times before 1970 too."""
    return seconds - F.pmod(seconds, F.lit(width) if isinstance(width, int) else width)


def _dimensions() -> Column:
    one = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("dimension_value"))
    return F.explode(F.array(one("all", F.lit("")), one("model", F.col("model")), one("project", F.coalesce("project_alias", F.lit("")))))


def time_rollup(events: DataFrame, *also: str) -> DataFrame:
    """Minute buckets first; hours are sums of minutes, so events are expanded by dimension alone. `also` names further keys."""
    wide = events.select("*", _dimensions().alias("d")).select("*", "d.*")
    keys = [bucket(F.col("timestamp_seconds"), MINUTE).alias("minute"), "provider_id", "profile_id", "dimension", "dimension_value", *also]
    minutes = wide.groupBy(*keys).agg(*metric_aggregates())
    both = minutes.select("*", F.explode(F.array(F.lit(MINUTE), F.lit(HOUR))).alias("bucket_width"))
    both = both.withColumn("bucket_width", F.col("bucket_width").cast("bigint"))
    return both.groupBy("bucket_width", bucket(F.col("minute"), F.col("bucket_width")).alias("bucket_start"), *TIME_KEYS[2:], *also).agg(*merged_metrics())


def session_rollup(events: DataFrame) -> DataFrame:
    """Metrics of each session by dimension, with its first and last moment."""
    wide = events.select("*", _dimensions().alias("d")).select("*", "d.*")
    # one number a moment: structs would make the aggregation sort all its rows, numbers are combined by hash
    at = F.col("timestamp_seconds").cast("decimal(20,0)") * F.lit(NANOS).cast("decimal(10,0)") + F.col("timestamp_nanos").cast("decimal(20,0)")
    out = wide.groupBy(*SESSION_KEYS).agg(*metric_aggregates(), F.min(at.cast(_MOMENT)).alias("a"), F.max(at.cast(_MOMENT)).alias("z"))
    every, pick = F.col("dimension") == "all", {}
    for name, side in (("first", "a"), ("last", "z")):
        nanos = F.pmod(F.col(side), F.lit(NANOS).cast(_MOMENT))
        pick[f"{name}_seconds"] = F.when(every, ((F.col(side) - nanos) / F.lit(NANOS).cast("decimal(10,0)")).cast("bigint"))
        pick[f"{name}_nanos"] = F.when(every, nanos.cast("bigint"))
    return out.withColumns(pick).drop("a", "z")


def merge(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = TIME_KEYS) -> DataFrame:
    """Sum of two rollups by key."""
    return left.unionByName(right).groupBy(*keys).agg(*merged_metrics())


def retract(rollup: DataFrame, removed: DataFrame, keys: tuple[str, ...] = TIME_KEYS) -> DataFrame:
    """A rollup without the events of another; keys without events go."""
    return merge(rollup, removed.select(*keys, *[(-F.col(m)).alias(m) for m in METRICS]), keys).filter("event_count > 0")


def _priced(events: DataFrame) -> DataFrame:
    cost = F.col("reported_cost_usd_micros")
    context = F.when(F.col("long_context") == "yes", "long").when(F.col("long_context") == "no", "short").otherwise("unavailable")
    return events.withColumns({"tier": price_tier(F.col("service_tier")), "context": context, "reported_state": F.when(cost.isNull(), "missing").otherwise("present"), "calculable": calculable().cast("bigint"), **price_basis()})


PRICE_KEYS = ("model", "tier", "context", "reported_state")


def _price_sums() -> list[Column]:
    sums = [F.count("*").alias("event_count"), F.sum("calculable").alias("calculable_events"), F.count("reported_cost_usd_micros").alias("reported_events")]
    sums += [F.sum(c).cast("bigint").alias(c) for c in ("uncached", "cached", "billable")]
    return sums + [F.sum("reported_cost_usd_micros").cast("bigint").alias("reported_cost")]


PRICE_SUMS = ("event_count", "calculable_events", "reported_events", "uncached", "cached", "billable", "reported_cost")
PRICE_TIME_KEYS = ("bucket_width", "bucket_start", "provider_id", "profile_id", "project", *PRICE_KEYS)
PRICE_SESSION_KEYS = ("provider_id", "profile_id", "session_id", "project", *PRICE_KEYS)


def price_merged() -> list[Column]:
    """Sums of price-basis rows; no reported cost at all stays unknown."""
    return [F.sum(s).cast("bigint").alias(s) for s in PRICE_SUMS]


def price_rows(kept: DataFrame, *target: Column | str) -> DataFrame:
    """Price-basis rows of each target from kept price rollups, as price_basis_rows gives them from events."""
    return kept.groupBy(*target, *PRICE_KEYS).agg(*price_merged())


def price_widths(events: DataFrame) -> DataFrame:
    """The price rollup by minutes and by hours; hours are sums of minutes."""
    minutes = price_time_rollup(events, MINUTE).withColumnRenamed("bucket_start", "minute")
    both = minutes.select("*", F.explode(F.array(F.lit(MINUTE), F.lit(HOUR))).alias("w")).withColumn("bucket_width", F.col("w").cast("bigint"))
    return both.groupBy("bucket_width", bucket(F.col("minute"), F.col("bucket_width")).alias("bucket_start"), *PRICE_TIME_KEYS[2:]).agg(*price_merged())


def price_time_rollup(events: DataFrame, width: int = HOUR) -> DataFrame:
    at = bucket(F.col("timestamp_seconds"), width).alias("bucket_start")
    return _priced(events).groupBy(at, "provider_id", "profile_id", F.coalesce("project_alias", F.lit("")).alias("project"), *PRICE_KEYS).agg(*_price_sums())


def price_session_rollup(events: DataFrame) -> DataFrame:
    return _priced(events).groupBy("provider_id", "profile_id", "session_id", F.coalesce("project_alias", F.lit("")).alias("project"), *PRICE_KEYS).agg(*_price_sums())


def price_basis_rows(events: DataFrame, *target: Column | str) -> DataFrame:
    return _priced(events).groupBy(*target, *PRICE_KEYS).agg(*_price_sums())
