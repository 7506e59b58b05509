"""Stores of a dataset: what price, page and rhythm queries read, and how they are published."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallymill.operators import analytics, calendar, rollup
from tallymill.plans import registry, usage
from tallymill.sources import jsonl, stored, testdata

SF = "/root/testdata/sf0.001"


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p1_price_basis", "p1_omitted_events", "p2_session_basis", "p3_price_batch_days", "p4_price_batch_projects", "p5_price_batch_sessions", "p5_session_breakdown", "p12_cost_auto_days", "p12_cost_calculated_models", "p12_cost_reported_days"])
def test_prices_come_from_their_store(spark, name):
    plan = _plan(registry.queries()[name](spark, SF))
    assert "prices-" in plan and "props" not in plan and "events.parquet" not in plan
    if not name.startswith(("p2", "p5")):
        assert "PartitionFilters" in plan and "GreaterThanOrEqual(bucket_start" in plan


def test_stored_prices_are_those_of_the_events(spark):
    events = testdata.usage_event(spark, SF)
    inside = events.filter(F.col("timestamp_seconds").between(usage.START, usage.END - 1))
    kept = analytics.in_range(usage.prices(spark, SF), [(0, usage.START, usage.END)])
    want = rollup.price_basis_rows(inside, "provider_id")
    got = rollup.price_rows(kept, "provider_id").select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_first_readers_agree_on_one_store(spark, tmp_path):
    path, built = str(tmp_path / "store"), []

    def slow(at):
        built.append(at)
        if len(built) == 1:  # another reader publishes while this one builds
            stored.published(spark, path, slow)
        spark.range(len(built)).write.parquet(at)

    first = stored.published(spark, path, slow)
    assert len(built) == 2 and first == built[1] == stored.published(spark, path, slow) and len(built) == 2


def test_pages_read_a_stretch_of_the_store(spark):
    events, bounds = usage.events(spark, SF), usage.bounds(spark, SF)
    assert "LessThanOrEqual(timestamp_seconds" in _plan(analytics.activity_page(events, 20, (1_705_000_000, 0, "")))
    every, at, seen = events.orderBy(*[F.desc(c) for c in ("timestamp_seconds", "timestamp_nanos", "fingerprint")]).limit(200), None, []
    for _ in range(4):
        page, at = analytics.cursor_page(events, "d", at, 50, bounds)
        seen += [r.fingerprint for r in page.collect()]
    assert seen == [r.fingerprint for r in every.collect()]
    low = bounds[0]
    assert analytics.activity_page(events, 50, (low + 1, 0, ""), bounds).count() <= 50
    none = events.limit(0)
    assert analytics.horizon(rollup.time_rollup(none)) == (0, 0) and analytics.activity_page(none, 50, bounds=(0, 0)).count() == 0


@pytest.mark.parametrize(("zone", "first", "days"), [("America/New_York", date(2024, 3, 1), 20), ("Australia/Lord_Howe", date(2024, 4, 1), 10), ("Asia/Kathmandu", date(2024, 1, 1), 2), ("Pacific/Apia", date(2011, 12, 28), 6)])
def test_rhythm_buckets_are_the_minutes(spark, zone, first, days):
    start, end = (calendar.day_start(date.fromordinal(first.toordinal() + k), zone) for k in (0, days))
    start += 60 * 7
    minutes = calendar.rhythm_minutes(spark, start, end, zone).select("minute", "hour", "weekday")
    buckets = calendar.rhythm_buckets(spark, start, end, zone)
    each = buckets.select(F.explode(F.sequence("bucket_start", F.col("bucket_start") + F.col("bucket_width") - 60, F.lit(60).cast("long"))).alias("minute"), "hour", "weekday")
    assert each.exceptAll(minutes).isEmpty() and minutes.exceptAll(each).isEmpty()
    hours = buckets.filter("bucket_width = 3600").count()
    assert hours == 0 if zone == "Asia/Kathmandu" else hours > 24
    with pytest.raises(ValueError):
        calendar.rhythm_buckets(spark, 0, 40 * 86_400, zone)


def test_a_file_without_a_stem_has_a_hashed_hint(spark):
    line = '{"type":"event_msg","timestamp":5,"payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":3}}}}'
    rows = spark.createDataFrame([("f", name, "sessions", 0, line) for name in ("noext", "deep/a.jsonl")], "file string, relative string, place string, source_offset long, value string")
    got = {r.relative: r.session_id for r in jsonl.observations(rows.withColumn("file", F.col("relative"))).collect()}
    assert got["deep/a.jsonl"] == "a" and got["noext"].startswith("file_") and len(got["noext"]) == 37


def test_sessions_are_combined_by_hash_and_keep_their_moments(spark):
    """Moments before 1970 and of late years keep seconds and nanos; no aggregation sorts the events."""
    base = testdata.usage_event(spark, SF).limit(1).withColumn("session_id", F.lit("s"))
    moments = [(-5, 999_999_999), (-5, 1), (253_402_300_799, 7), (0, 0)]
    rows = base.drop("timestamp_seconds", "timestamp_nanos").crossJoin(spark.createDataFrame(moments, "timestamp_seconds long, timestamp_nanos long"))
    got = rollup.session_rollup(rows)
    one = got.filter("dimension = 'all'").first()
    assert (one.first_seconds, one.first_nanos, one.last_seconds, one.last_nanos, one.event_count) == (-5, 1, 253_402_300_799, 7, 4)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_pages_build_no_rollup_for_their_bounds(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("a page needs no rollup")

    monkeypatch.setattr(usage, "kept", fail)
    for name in ("u10_activity_page", "u10_activity_cursor", "u12_session_page", "u12_session_cursor", "u15_cursors", "u16_event_page", "u10_has_more"):
        registry.queries()[name](spark, SF).collect()


def test_one_file_of_all_old_events_is_many_parts(spark):
    """All events of one source file are joined in many parts, with each row as before, also of a file with two sources."""
    events = spark.range(2000).select("id", F.lit("f").alias("selected_file_key"), F.lit("x").alias("provider_id"), F.concat(F.lit("p"), F.col("id") % 2).alias("profile_id"))
    sources = spark.createDataFrame([("f", "codex", "p0"), ("f", "local", "p2")], "file_key string, provider_id string, profile_id string")
    got = analytics.legacy_events(events, sources)
    assert {(r.profile_id, r.provider_id): r["count"] for r in got.groupBy("profile_id", "provider_id").count().collect()} == {("p0", "codex"): 1000, ("p0", "unknown"): 1000, ("p1", "unknown"): 2000}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = analytics.legacy_events(events, sources).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 1


def test_one_repository_of_all_changes_is_many_parts(spark):
    """Changes of one repository meet the failed ones in many parts; those of a failed one all go."""
    from tallymill.operators import git_output

    rows = spark.range(2000).select(F.when(F.col("id") < 1900, 1).otherwise(2).alias("repository_id"), F.col("id").alias("n"), F.when(F.col("id") == 1950, "cut").alias("error"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = git_output.sound(rows).groupBy("repository_id", F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert {r.repository_id for r in got} == {1} and sum(r["count"] for r in got) == 1900 and len(got) > 1
