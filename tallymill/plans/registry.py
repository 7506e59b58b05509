"""Registered queries of the analytics engine, named by the inventory's ids, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.checkpoints import shared_folder
from tallymill.functions.measures import METRICS, availability, freshness, share_ppm
from tallymill.operators import analytics, benefit, calendar, git_output, lineage, pricing, rollup, status
from tallymill.plans import benefits, ingest, oracle, output, replay, usage, windows
from tallymill.sources import provider, testdata
from tallymill.streaming.rollups import RollupStore

FIRST, LAST, ZONE = date(2024, 1, 3), date(2024, 1, 24), "America/New_York"
START, END = calendar.day_start(FIRST, ZONE), calendar.day_start(LAST, ZONE)
SCOPES = [("local", "profile_0"), ("codex", "profile_1"), ("codex", "profile_2")]
NOW_MS = 807_000_000_000
Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[name] = f
        return f

    return add


def _events(spark, sf_dir):
    return testdata.usage_event(spark, sf_dir)


def _rollup(spark, sf_dir):
    return rollup.time_rollup(_events(spark, sf_dir))


def _kept(spark, sf_dir):
    return usage.kept(spark, sf_dir)


def _targets():
    return calendar.day_targets(FIRST, LAST, ZONE)


query("a0_usage_events")(_events)
query("c2_event_identity")(lambda s, d: testdata.usage_event(s, d, True).select("source_offset", "fingerprint", "event_id"))
query("a2_time_rollup")(_rollup)
query("a5_session_rollup")(lambda s, d: rollup.session_rollup(_events(s, d)))
query("a9_price_time_rollup")(lambda s, d: rollup.price_time_rollup(_events(s, d)))
query("a10_price_session_rollup")(lambda s, d: rollup.price_session_rollup(_events(s, d)))


@query("a4_merged_rollup")
def merged(spark, sf_dir):
    e = _events(spark, sf_dir)
    return rollup.merge(*[rollup.time_rollup(e.filter(F.col("source_offset") % 2 == k)) for k in (0, 1)])


@query("a11_retracted_rollup")
def retracted(spark, sf_dir):
    e = _events(spark, sf_dir)
    return rollup.retract(rollup.time_rollup(e), rollup.time_rollup(e.filter(F.col("source_offset") % 3 == 0)))


@query("a11_streamed_changes")
def changed(spark, sf_dir):
    """Arrivals, removals and updates in three batches, compacted between; what is left is as in a11_retracted_rollup."""
    e, n = _events(spark, sf_dir), F.col("source_offset")
    of = lambda kind, rows: rows.withColumn("change", F.lit(kind))
    even, odd, gone = e.filter(n % 2 == 0), e.filter(n % 2 == 1), n % 3 == 0
    updated = e.filter((n % 5 == 0) & ~gone)
    store = RollupStore(spark, f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}", every=2)
    store.apply_changes(of("insert", even), 0)
    store.apply_changes(of("insert", odd).unionByName(of("delete", even.filter(gone))), 1)
    store.apply_changes(of("delete", odd.filter(gone)).unionByName(of("delete", updated)).unionByName(of("insert", updated)), 2)
    return store.read()


query("u1_overview")(lambda s, d: analytics.overview(_kept(s, d), START, END))
query("u2_scoped_overview")(lambda s, d: analytics.overview(_kept(s, d), START, END, SCOPES))
query("u3_daily_series")(lambda s, d: analytics.daily_series(_kept(s, d), _targets()))
for _kind in ("model", "project", "provider", "profile"):
    query(f"u4_breakdown_{_kind}")(lambda s, d, k=_kind: analytics.breakdown(_kept(s, d), START, END, k))

def _rhythm(name: str) -> Query:
    def run(spark, sf_dir):
        keys = {"hours": (F.col("hour"), 24), "weekdays": (F.col("weekday"), 7), "cells": (F.col("weekday") * 24 + F.col("hour"), 168)}
        return analytics.rhythm(_kept(spark, sf_dir), calendar.rhythm_buckets(spark, START, END, ZONE), *keys[name])

    return run


for _name in ("hours", "weekdays", "cells"):
    query(f"u5_rhythm_{_name}")(_rhythm(_name))
query("d7_hour_exposure")(lambda s, d: calendar.exposure(s, *usage.bounds(s, d), ZONE, "hour").drop("occurrences"))
query("u7_lifetime")(lambda s, d: analytics.lifetime(_kept(s, d)))


@query("u8_availability")
def available(spark, sf_dir):
    got = analytics.breakdown(_kept(spark, sf_dir), START, END, "model")
    return got.select("dimension_value", *[availability(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens", "total_tokens")])


_PAGE = ("timestamp_seconds", "timestamp_nanos", "fingerprint", "session_id", "total_tokens")
query("u10_activity_page")(lambda s, d: analytics.activity_page(usage.events(s, d), 200, bounds=usage.event_bounds(s, d)).select(*_PAGE))
query("u10_activity_cursor")(lambda s, d: analytics.activity_page(usage.events(s, d), 100, (1_705_000_000, 0, ""), usage.event_bounds(s, d)).select(*_PAGE))
_SESSION = ("provider_id", "profile_id", "session_id", "last_seconds", "last_nanos", "event_count", "sum_total_tokens")
query("u12_session_page")(lambda s, d: analytics.session_page(usage.sessions(s, d), 100, bounds=usage.session_bounds(s, d)).select(*_SESSION))
query("u12_session_cursor")(lambda s, d: analytics.session_page(usage.sessions(s, d), 100, (1_706_500_000, 0, "", "", ""), usage.session_bounds(s, d)).select(*_SESSION))
query("u13_session_detail")(lambda s, d: analytics.session_detail(usage.sessions(s, d), "local", "profile_0", "session_0"))
query("u14_session_models")(lambda s, d: analytics.session_detail(usage.sessions(s, d), "local", "profile_0", "session_0", "model").select("dimension_value", *METRICS))


def _priced(spark, sf_dir, *target):
    """Price-basis rows of the range from the stored price rollup."""
    return rollup.price_rows(analytics.in_range(usage.prices(spark, sf_dir), [(0, START, END)]).drop("target"), *target)


def _priced_days(spark, sf_dir):
    kept = analytics.in_range(usage.prices(spark, sf_dir), _targets())
    return rollup.price_rows(kept, F.col("target").alias("day"))


query("p1_price_basis")(lambda s, d: _priced(s, d).orderBy(*pricing.rank()).limit(pricing.ROWS))
query("p3_price_batch_days")(lambda s, d: pricing.batch(_priced_days(s, d), "day"))
query("p4_price_batch_projects")(lambda s, d: pricing.batch(_priced(s, d, "project"), "project"))
query("p5_price_batch_sessions")(lambda s, d: pricing.batch(rollup.price_rows(usage.session_prices(s, d), *lineage.KEY), *lineage.KEY))
query("p6_catalogue")(lambda s, d: usage.rated_models(s, d, pricing.catalogue(s)))


def _cost(mode: str, *target: str) -> Query:
    return lambda s, d: pricing.select_cost(_priced_days(s, d), pricing.catalogue(s), *target, mode=mode)


query("p12_cost_auto_days")(_cost("auto", "day"))
query("p12_cost_calculated_models")(lambda s, d: pricing.select_cost(_priced(s, d, F.col("model").alias("target")), pricing.catalogue(s), "target", mode="calculated"))
query("p12_cost_reported_days")(_cost("reported", "day"))
query("c6_canonical_pick")(lambda s, d: lineage.canonical(_copies(s, d)))


def _copies(spark, sf_dir):
    e = testdata.usage_event(spark, sf_dir, True).select("fingerprint", "profile_id", "source_offset", "total_tokens")
    each = e.select("*", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("file_key"), (F.col("source_offset") % 2).alias("generation"))
    return each.select("fingerprint", "profile_id", "file_key", "generation", "source_offset", "total_tokens")


query("b1_reconcile")(lambda s, d: benefit.reconcile(testdata.benefit_lots(s, d, False), testdata.benefit_lots(s, d, True)))
query("b1_reconcile_partial")(lambda s, d: benefit.reconcile(testdata.benefit_lots(s, d, False), testdata.benefit_lots(s, d, True), complete=False))
query("b4_reminders")(lambda s, d: benefit.schedule(testdata.benefit_lots(s, d, False)))
query("b5_due_reminders")(lambda s, d: benefit.due(benefit.schedule(testdata.benefit_lots(s, d, False)), NOW_MS))
query("b8_fefo")(lambda s, d: benefit.first_expired_first(testdata.benefit_lots(s, d, False)))
query("b9_nearest_expiry")(lambda s, d: benefit.nearest(testdata.benefit_lots(s, d, False)))
query("g1_day_categories")(lambda s, d: git_output.day_categories(testdata.git_changes(s, d)))
query("g3_days")(lambda s, d: git_output.days(testdata.git_changes(s, d)))
query("g5_range_categories")(lambda s, d: git_output.range_categories(git_output.day_categories(testdata.git_changes(s, d)), 9000, 9400))


@query("g10_efficiency")
def efficient(spark, sf_dir):
    """Cost per product line: repository k goes with project proj_k."""
    lines = git_output.day_categories(testdata.git_changes(spark, sf_dir)).filter("category = 'product_code'").groupBy(F.concat(F.lit("proj_"), "repository_id").alias("project")).agg(F.sum("added").cast("bigint").alias("lines"))
    cost = pricing.select_cost(_priced(spark, sf_dir, "project"), pricing.catalogue(spark), "project")
    return cost.join(lines, "project", "left").select("project", "amount", "lines", git_output.efficiency(F.col("amount"), F.col("lines")).alias("per_100_lines"))


query("s19_quota_windows")(lambda s, d: provider.quota_windows(testdata.quota_snapshots(s, d)))
query("b13_removable_changes")(lambda s, d: benefit.removable_changes(testdata.benefit_changes(s, d)).select("scope_id", "lot_id", "sequence"))
query("b15_due_rebuilt")(lambda s, d: benefit.rebuild_due(_reminders(s, d), _reminders(s, d).filter("lot_id % 5 = 0 AND lead_seconds = 86400")))
query("a13_legacy_events")(lambda s, d: _legacy(s, d).select("source_offset", "provider_id", "profile_id", "selected_file_key"))
query("u11_legacy_page")(lambda s, d: analytics.legacy_page(*_legacy_parts(s, d, True), 200).select(*_PAGE, "provider_id"))


def _reminders(spark, sf_dir):
    return benefit.schedule(testdata.benefit_lots(spark, sf_dir, False))


def _legacy_parts(spark, sf_dir, identity=False):
    e = testdata.usage_event(spark, sf_dir, identity).withColumn("selected_file_key", F.concat(F.lit("f"), F.col("source_offset") % 5))
    known = e.filter("source_offset % 5 < 3").select(F.col("selected_file_key").alias("file_key"), F.lit("codex").alias("provider_id"), F.concat(F.lit("profile_"), F.col("source_offset") % 5).alias("profile_id")).distinct()
    return e, known


def _legacy(spark, sf_dir):
    return analytics.legacy_events(*_legacy_parts(spark, sf_dir))


@query("b14_rehydrated_lots")
def rehydrated(spark, sf_dir):
    changes = testdata.benefit_changes(spark, sf_dir)
    revisions = changes.select("scope_id", "lot_id", F.col("before_revision").alias("lot_revision"), (F.col("before_revision") % 10).alias("quantity"))
    lots = changes.select("scope_id", "lot_id").distinct()
    return benefit.rehydrated(changes, revisions, lots.filter("lot_id % 5 = 0"), lots.filter("lot_id % 3 <> 0"))


query("x1_model_shares")(lambda s, d: status.model_shares(analytics.breakdown(_kept(s, d), START, END, "model")).select("dimension_value", "share_ppm"))
query("x2_cache_hits")(lambda s, d: analytics.breakdown(_kept(s, d), START, END, "model").select("dimension_value", share_ppm(F.col("sum_cached_tokens"), F.col("sum_input_tokens")).alias("cache_hit_ppm")))


@query("t1_session_freshness")
def fresh(spark, sf_dir):
    last = _events(spark, sf_dir).groupBy("session_id", "provider_id").agg(F.max("timestamp_seconds").alias("last"))
    return last.select("session_id", freshness(F.lit(1_706_659_200) - F.col("last")).alias("freshness"))


@query("t4_worst_freshness")
def worst(spark, sf_dir):
    last = _events(spark, sf_dir).groupBy("session_id", "provider_id").agg(F.max("timestamp_seconds").alias("last"))
    return last.withColumn("f", freshness(F.lit(1_706_659_200) - F.col("last"))).groupBy("provider_id").agg(status.worst(F.col("f")).alias("worst"))


@query("t9_prunable_scans")
def prunable(spark, sf_dir):
    e = testdata.read(spark, sf_dir, "events")
    return status.prunable_scans(e.select(F.concat(F.lit("scope_"), F.col("user_id") % 16).alias("scope_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("started_at"), F.col("event_id").alias("scan_id")))


#: Groups of queries with their SQL beside them.
MODULES = (replay, ingest, windows, output, benefits, usage)


def queries() -> dict[str, Query]:
    found = dict(_found)
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = oracle.statements(START, END, _targets(), SCOPES, NOW_MS)
    found["a11_streamed_changes"] = found["a11_retracted_rollup"]
    for module in MODULES:
        found |= module.sql(oracle.FINGERPRINTED) if module is usage else module.SQL
    return found


def entry(spark: SparkSession) -> DataFrame:
    """The model breakdown of three weeks."""
    return _found["u4_breakdown_model"](spark, "/root/testdata/sf0.001")
