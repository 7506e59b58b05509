"""Derived dashboard values and status: shares, cache hits, worst-of merges, import progress, scan history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.measures import share_ppm

#: From best to worst.
FRESHNESS = ("fresh", "aging", "stale", "unavailable")
SCANS = 32


def worst(state: Column, order: tuple[str, ...] = FRESHNESS) -> Column:
    """The worst of a group's states, which are listed from best to worst."""
    known = F.array(*map(F.lit, order))
    return F.element_at(known, F.max(F.array_position(known, state)).cast("int"))


def model_shares(breakdown: DataFrame, value: str = "sum_total_tokens") -> DataFrame:
    """Each row's share of the leader, in parts per million; null where the leader has none. A breakdown has at most 256 rows."""
    leader = breakdown.agg(F.max(value).alias("leader"))
    return breakdown.crossJoin(F.broadcast(leader)).withColumn("share_ppm", share_ppm(F.col(value), F.col("leader"))).drop("leader")


def prunable_scans(scans: DataFrame, keep: int = SCANS) -> DataFrame:
    """Scans beyond the newest of each scope."""
    rank = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("started_at"), F.desc("scan_id")))
    return scans.withColumn("n", rank).filter(F.col("n") > keep).drop("n")


def manifest_difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of either manifest that the other has not; empty if both are equal."""
    return expected.exceptAll(found).withColumn("side", F.lit("expected")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("found")))


def dataset_quality(identity: Column, quality: Column, versions_current: Column) -> Column:
    """(quality, warnings) of a dataset: legacy and outdated ones are unknown; null quality where the state cannot be."""
    legacy = identity == "legacy_snapshot"
    mapped = F.when((quality == "empty") & (identity == "empty"), "authoritative").when(quality == "complete", "authoritative").when(quality.isin("partial", "recovery_pending"), "partial")
    warnings = F.array_compact(F.array(F.when(legacy, "legacy_unverified"), F.when(~legacy & quality.isin("partial", "recovery_pending"), quality), F.when(~legacy & mapped.isNotNull() & ~versions_current, "accounting_version_stale")))
    return F.struct(F.when(legacy, "unknown").when(mapped.isNotNull() & ~versions_current, "unknown").otherwise(mapped).alias("quality"), warnings.alias("warnings"))


def scan_truth(scan_sets: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_set_id, completed_at_ms, scopes, sound): sound where the set and as many of its scans as expected are complete."""
    done = scans.groupBy("scan_set_id").agg(F.count_if(F.col("completion_state") == "complete").alias("completed"), F.count("*").alias("scopes"))
    rows = scan_sets.join(done, "scan_set_id", "left").fillna(0, ["completed", "scopes"])
    sound = (F.col("completion_state") == "complete") & F.coalesce(F.col("completed_at_ms") > 0, F.lit(False)) & (F.col("completed") == F.col("expected_scopes")) & (F.col("scopes") == F.col("expected_scopes"))
    return rows.select("scan_set_id", "completed_at_ms", "scopes", sound.alias("sound"))


def import_progress(revisions: DataFrame, sources: DataFrame) -> DataFrame:
    """(revision_id, complete_sources, expected_sources) of partial revisions; null counts where sources do not add up."""
    per = sources.groupBy("revision_id").agg(F.count_if(F.col("state") == "complete").alias("done"), F.count("*").alias("all"))
    rows = revisions.filter("quality = 'partial'").join(per, "revision_id", "left").fillna(0, ["done", "all"])
    ok = F.col("all") == F.col("expected_sources")
    return rows.select("revision_id", F.when(ok, F.col("done")).alias("complete_sources"), F.when(ok, F.col("expected_sources")).alias("expected_sources"))


def product_status(**parts: DataFrame) -> DataFrame:
    """One row of structs from frames of one row each; a part that is empty is null."""
    rows = None
    for name, part in parts.items():
        one = part.agg(F.first(F.struct("*")).alias(name))
        rows = one if rows is None else rows.crossJoin(F.broadcast(one))  # one row by one row
    return rows


def integrity(counters: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check, told, counted, sound): each counter of a state row (column told) against the rows it counts."""
    out = None
    for name, (state, rows) in counters.items():
        row = state.select(F.lit(name).alias("check"), F.col("told").cast("bigint").alias("told")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("counted"))))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("sound", F.col("told") == F.col("counted"))


def strangers(rollup: DataFrame, active: int) -> DataFrame:
    """Rollup rows of another generation than the active one; there should be none."""
    return rollup.filter(F.col("generation") != active)


def trend_maxima(series: DataFrame) -> DataFrame:
    """The greatest known token sum and cost of a series."""
    return series.agg(F.max(F.when(F.col("event_count").isNotNull() & (F.col("known_total_tokens") > 0), F.col("sum_total_tokens"))).alias("max_tokens"), F.max("amount").alias("max_cost"))
