"""Usage and cost: further registered queries over the stored rollup, and the same in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallymill.functions.measures import elapsed_ppm
from tallymill.operators import analytics, calendar, pricing, rollup, status
from tallymill.plans.oracle import MINUTES, PKEYS, PRANK, PRICED, PSUMS, UE, ZERO, batch_sql
from tallymill.sources import testdata
from tallymill.sources.stored import fingerprint, stored_events, stored_prices, stored_rollup, stored_session_prices, stored_sessions

FIRST, LAST, ZONE = date(2024, 1, 3), date(2024, 1, 24), "America/New_York"
START, END = calendar.day_start(FIRST, ZONE), calendar.day_start(LAST, ZONE)
TARGETS = calendar.day_targets(FIRST, LAST, ZONE)
_FIVE = ("timestamp_seconds", "timestamp_nanos", "fingerprint", "session_id", "total_tokens")


def kept(spark, sf_dir):
    """The stored time rollup of the synthetic events."""
    return stored_rollup(spark, testdata.usage_event(spark, sf_dir), f"{sf_dir}/events.parquet")


def prices(spark, sf_dir):
    """The stored price rollup of the synthetic events."""
    return stored_prices(spark, testdata.usage_event(spark, sf_dir), f"{sf_dir}/events.parquet")


def session_prices(spark, sf_dir):
    return stored_session_prices(spark, testdata.usage_event(spark, sf_dir), f"{sf_dir}/events.parquet")


def events(spark, sf_dir):
    """The synthetic events with their identity in order of time, as pages read them."""
    return stored_events(spark, testdata.usage_event(spark, sf_dir, True), f"{sf_dir}/events.parquet")


def sessions(spark, sf_dir):
    return stored_sessions(spark, testdata.usage_event(spark, sf_dir), f"{sf_dir}/events.parquet")


def bounds(spark, sf_dir):
    return analytics.horizon(kept(spark, sf_dir))


def event_bounds(spark, sf_dir):
    """The bounds of the events from their own store, for pages: one column is read, and no rollup is built."""
    return analytics.span(events(spark, sf_dir), "timestamp_seconds")


def session_bounds(spark, sf_dir):
    return analytics.span(sessions(spark, sf_dir).filter("dimension = 'all'"), "last_seconds")


def rated_models(spark, sf_dir, catalogue):
    """The models of the events, each with its rates by tier and context (none where it is not priced)."""
    hours = kept(spark, sf_dir).filter("dimension = 'model' AND bucket_width = 3600")
    return hours.select(F.col("dimension_value").alias("name")).distinct().join(catalogue, "name", "left")


def _cursors(spark, sf_dir):
    """Three pages by cursors of this dataset, and what becomes of one of another: (page, events, first, state)."""
    dataset, rows, limits, at, out = fingerprint(spark, f"{sf_dir}/events.parquet"), events(spark, sf_dir), event_bounds(spark, sf_dir), None, []
    for k in range(3):
        page, at = analytics.cursor_page(rows, dataset, at, 90, limits)
        n, first = page.agg(F.count("*"), F.max("timestamp_seconds")).first()
        out.append((k, n, first, "current"))
    try:
        analytics.cursor_page(rows, "another dataset", at, 90, limits)
    except ValueError:
        out.append((3, 0, None, "stale"))
    return spark.createDataFrame(out, "page long, events long, first long, state string")


def _full(spark, sf_dir):
    return analytics.full_analytics(kept(spark, sf_dir), START, END, TARGETS, zone=ZONE).select("kind", "key", "key2", "event_count", "sum_total_tokens", "known_input_tokens", "activity_read", "truncated")


def _rhythm(spark, sf_dir):
    return analytics.rhythm_sums(kept(spark, sf_dir), calendar.rhythm_buckets(spark, START, END, ZONE))


def _broken(spark, sf_dir):
    odd = F.col("bucket_start") % 7 == 3
    rows = kept(spark, sf_dir).withColumn("fallback_events", F.when(odd, F.col("event_count") + 1).otherwise(F.col("fallback_events")))
    return analytics.broken_metrics(rows).select("bucket_width", "bucket_start", "provider_id", "profile_id", "dimension", "dimension_value")


def _lookahead(spark, sf_dir):
    e = analytics.newest(events(spark, sf_dir).select(*_FIVE), _FIVE[0], 121, event_bounds(spark, sf_dir))
    return analytics.with_lookahead(e, [F.desc(c) for c in _FIVE[:3]], 120)


def _last_page(spark, sf_dir):
    e = events(spark, sf_dir).select(*_FIVE).filter("timestamp_seconds < 1704074400")
    return analytics.with_lookahead(e, [F.desc(c) for c in _FIVE[:3]], 1000)


def _basis(spark, sf_dir, *target):
    return rollup.price_rows(analytics.in_range(prices(spark, sf_dir), [(0, START, END)]).drop("target"), *target)


def _of_session(spark, sf_dir):
    """The kept price rows of one session, known by provider, profile and name."""
    return session_prices(spark, sf_dir).filter("provider_id = 'codex' AND profile_id = 'profile_1' AND session_id = 'session_1'")


def _session(spark, sf_dir):
    return rollup.price_rows(_of_session(spark, sf_dir)).orderBy(*pricing.rank()).limit(pricing.ROWS)


def _session_items(spark, sf_dir):
    return pricing.batch(rollup.price_rows(_of_session(spark, sf_dir), F.col("model").alias("item")), "item")


def _day_basis(spark, sf_dir):
    return rollup.price_rows(analytics.in_range(prices(spark, sf_dir), TARGETS), "target")


def _rates(spark, sf_dir):
    parts = testdata.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    text = F.when(F.col("k") % 5 == 0, F.concat("k", F.lit(".1234567"))).when(F.col("k") % 5 == 1, F.concat("k", F.lit("."))).when(F.col("k") % 5 == 2, F.concat("k", F.lit(".25"))).when(F.col("k") % 5 == 3, F.concat("k", F.lit("000000"))).otherwise(F.concat("k", F.lit(".000001")))
    return parts.select("k", pricing.parse_rate(text).alias("micros"))


def _overridden(spark, sf_dir):
    rows, _ = pricing.snapshot({"gpt-5-nano": {("standard", "short"): (60_000, None, None)}, "own-model": {("standard", "short"): (1_000_000, 100_000, 2_000_000)}}, {"unpriced-model": "own-model"})
    got = pricing.catalogue(spark, rows)
    return rated_models(spark, sf_dir, got).filter(F.col("canonical").isin("gpt-5-nano", "own-model"))


def _incoherent(spark, sf_dir):
    rows = _basis(spark, sf_dir)
    return pricing.incoherent(rows.withColumn("calculable_events", F.when(F.col("model") == "gpt-5.5", F.col("event_count") + 1).otherwise(F.col("calculable_events")))).select(*rollup.PRICE_KEYS)


def _unaccounted(spark, sf_dir):
    rows = _day_basis(spark, sf_dir)
    days = analytics.daily_series(kept(spark, sf_dir), TARGETS).withColumn("event_count", F.when(F.col("target") == 3, F.col("event_count") + 1).otherwise(F.col("event_count")))
    return pricing.unaccounted(rows, days, "target")


def _trend(spark, sf_dir):
    cost = pricing.select_cost(_day_basis(spark, sf_dir), pricing.catalogue(spark), "target", mode="reported")
    return status.trend_maxima(analytics.daily_series(kept(spark, sf_dir), TARGETS).join(cost.select("target", "amount"), "target", "left"))


def _elapsed(spark, sf_dir):
    s = testdata.quota_samples(spark, sf_dir)
    return s.select("observation_id", elapsed_ppm(F.col("advertised_resets_at_ms") - 86_400_000, F.col("advertised_resets_at_ms"), F.col("observed_at_ms") + 3_600_000).alias("ppm"))


QUERIES = {
    "u4_full_analytics": _full,
    "u6_rhythm_sums": _rhythm,
    "u9_broken_metrics": _broken,
    "u10_has_more": _lookahead,
    "u15_last_page": _last_page,
    "u16_event_page": lambda s, d: analytics.activity_page(events(s, d), 256, (1_705_500_000, 0, ""), event_bounds(s, d)).select(*_FIVE),
    "u15_cursors": _cursors,
    "u17_probe_page": lambda s, d: analytics.probe_page(testdata.read(s, d, "events").select(F.col("event_id").alias("id"), "event_type"), 1000, 400),
    "d7_occurrences": lambda s, d: calendar.exposure(s, *bounds(s, d), ZONE, "weekday"),
    "p1_omitted_events": lambda s, d: pricing.page(_basis(s, d), 10).select(*rollup.PRICE_KEYS, "event_count", "all_events", "omitted_events"),
    "p2_session_basis": _session,
    "p5_session_breakdown": _session_items,
    "p8_rates": _rates,
    "p11_overrides": _overridden,
    "p14_incoherent_rows": _incoherent,
    "p15_unaccounted": _unaccounted,
    "x3_elapsed": _elapsed,
    "x4_trend_maxima": _trend,
}

_RANGE = f"timestamp_seconds >= {START} AND timestamp_seconds < {END}"
_ONE = "session_id = 'session_1' AND provider_id = 'codex' AND profile_id = 'profile_1'"
_SHORT = ("event_count", "sum_total_tokens", "known_input_tokens", "activity_read")
_SUM = "count(*) AS event_count, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS sum_total_tokens, count(input_tokens) AS known_input_tokens, CAST(coalesce(sum(activity_read), 0) AS BIGINT) AS activity_read"
_DAYS = "t(target, a, b) AS (VALUES " + ", ".join(f"({t}, {a}, {b})" for t, a, b in TARGETS) + ")"
_KINDS = {"overview": ("''", "''"), "model": ("model", "''"), "project": ("coalesce(project_alias, '')", "''"), "provider": ("provider_id", "''"), "profile": ("provider_id", "profile_id")}
_FP = ", ".join(_FIVE)


def sql(fingerprinted: str) -> dict[str, str]:
    """`fingerprinted` is the WITH clause that defines fpd, the events with their identity."""
    full = " UNION ALL ".join(f"SELECT '{k}' AS kind, {a} AS key, {b} AS key2, {_SUM}, false AS truncated FROM ue WHERE {_RANGE} GROUP BY ALL" if k != "overview" else f"SELECT 'overview', '', '', {_SUM}, false FROM ue WHERE {_RANGE}" for k, (a, b) in list(_KINDS.items())[1:] + list(_KINDS.items())[:1])
    local = f"timezone('{ZONE}', timezone('UTC', make_timestamp(timestamp_seconds * 1000000)))"
    clock = {"hour": f"extract(hour FROM {local})", "weekday": f"isodow({local}) - 1", "cell": f"(isodow({local}) - 1) * 24 + extract(hour FROM {local})"}
    beats = " UNION ALL ".join(f"SELECT '{k}', CAST(CAST({c} AS BIGINT) AS VARCHAR), '', {_SUM}, false FROM ue WHERE {_RANGE} GROUP BY ALL" for k, c in clock.items())
    newest = "timestamp_seconds DESC, timestamp_nanos DESC, fingerprint DESC"
    keys = "bucket_width, bucket_start, provider_id, profile_id, dimension, dimension_value"
    dims = "dm AS (SELECT *, 'all' AS dimension, '' AS dimension_value FROM ue UNION ALL SELECT *, 'model', model FROM ue UNION ALL SELECT *, 'project', coalesce(project_alias, '') FROM ue)"
    return {
        "u4_full_analytics": f"WITH {UE}, {_DAYS} {full} UNION ALL SELECT 'day', CAST(target AS VARCHAR), '', {_SUM}, false FROM ue JOIN t ON timestamp_seconds >= a AND timestamp_seconds < b GROUP BY target UNION ALL {beats}",
        "u6_rhythm_sums": f"WITH {UE} SELECT g AS \"grouping\", o.* FROM (SELECT {ZERO} FROM ue WHERE {_RANGE}) o, (VALUES ('hours'), ('weekdays'), ('cells')) v(g)",
        "u9_broken_metrics": f"WITH {UE}, {dims} SELECT DISTINCT {keys} FROM (SELECT dm.*, w AS bucket_width, timestamp_seconds // w * w AS bucket_start FROM dm, (VALUES (CAST(60 AS BIGINT)), (3600)) x(w)) WHERE bucket_start % 7 = 3",
        "u10_has_more": f"{fingerprinted} SELECT {_FP}, (SELECT count(*) FROM fpd) > 120 AS has_more FROM fpd ORDER BY {newest} LIMIT 120",
        "u15_last_page": f"{fingerprinted}, w AS (SELECT * FROM fpd WHERE timestamp_seconds < 1704074400) SELECT {_FP}, (SELECT count(*) FROM w) > 256 AS has_more FROM w ORDER BY {newest} LIMIT 256",
        "u15_cursors": f"""{fingerprinted}, n AS (SELECT *, (row_number() OVER (ORDER BY {newest}) - 1) // 90 AS page FROM fpd)
SELECT CAST(p AS BIGINT) AS page, (SELECT count(*) FROM n WHERE n.page = p) AS events, (SELECT max(timestamp_seconds) FROM n WHERE n.page = p) AS first, 'current' AS state FROM (SELECT unnest([0, 1, 2]) AS p)
UNION ALL SELECT 3, 0, NULL, 'stale'""",
        "u16_event_page": f"{fingerprinted} SELECT {_FP} FROM fpd WHERE timestamp_seconds < 1705500000 ORDER BY {newest} LIMIT 256",
        "u17_probe_page": "SELECT event_id AS id, event_type FROM events WHERE event_id < 400 ORDER BY event_id DESC LIMIT 256",
        "d7_occurrences": f"SELECT CAST(isodow(l) - 1 AS BIGINT) AS weekday, count(*) AS elapsed_minutes, count(DISTINCT date_trunc('hour', l)) AS occurrences FROM (SELECT timezone('America/New_York', timezone('UTC', make_timestamp(timestamp_seconds * 1000000))) AS l FROM ({MINUTES})) GROUP BY 1",
        "p1_omitted_events": f"WITH {UE}, {PRICED}, g AS (SELECT {PKEYS}, {PSUMS} FROM pb WHERE {_RANGE} GROUP BY ALL), k AS (SELECT * FROM g ORDER BY {PRANK} LIMIT 10) SELECT {PKEYS}, event_count, (SELECT CAST(sum(event_count) AS BIGINT) FROM g) AS all_events, (SELECT CAST(sum(event_count) AS BIGINT) FROM g) - (SELECT CAST(sum(event_count) AS BIGINT) FROM k) AS omitted_events FROM k",
        "p2_session_basis": f"WITH {UE}, {PRICED} SELECT {PKEYS}, {PSUMS} FROM pb WHERE {_ONE} GROUP BY ALL",
        "p5_session_breakdown": batch_sql("item", "model", f"WHERE {_ONE}"),
        "p8_rates": "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 2 THEN p_partkey * 1000000 + 250000 WHEN 3 THEN CASE WHEN p_partkey <= 1 THEN p_partkey * 1000000000000 END WHEN 4 THEN p_partkey * 1000000 + 1 END AS micros FROM part",
        "p11_overrides": f"WITH {UE} SELECT * FROM (VALUES ('gpt-5-nano', 'gpt-5-nano', 60000, 5000, 400000), ('gpt-5-nano-2025-08-07', 'gpt-5-nano', 60000, 5000, 400000), ('own-model', 'own-model', 1000000, 100000, 2000000), ('unpriced-model', 'own-model', 1000000, 100000, 2000000)) v(name, canonical, uncached_rate, cached_rate, output_rate), (VALUES ('standard', 'short')) w(tier_class, context) WHERE name IN (SELECT model FROM ue)",
        "p14_incoherent_rows": f"WITH {UE}, {PRICED} SELECT DISTINCT {PKEYS} FROM pb WHERE {_RANGE} AND model = 'gpt-5.5'",
        "p15_unaccounted": f"WITH {UE}, {_DAYS} SELECT CAST(target AS BIGINT) AS target, count(*) + 1 AS metric_events, count(*) AS priced_events FROM ue JOIN t ON timestamp_seconds >= a AND timestamp_seconds < b WHERE target = 3 GROUP BY 1",
        "x3_elapsed": "SELECT event_id AS observation_id, CAST(least((ms % 86400000 + 3600000) * 1000000 // 86400000, 1000000) AS BIGINT) AS ppm FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)",
        "x4_trend_maxima": f"""WITH {UE}, {_DAYS}, d AS (SELECT target, count(total_tokens) AS n, sum(total_tokens) AS s, sum(reported_cost_usd_micros) AS c FROM ue JOIN t ON timestamp_seconds >= a AND timestamp_seconds < b GROUP BY 1)
SELECT CAST(max(s) FILTER (n > 0) AS BIGINT) AS max_tokens, CAST(max(c) AS BIGINT) AS max_cost FROM d""",
    }
