"""DuckDB SQL that gives the same rows as the registered queries, for comparison."""

from __future__ import annotations

from tallymill.functions.identity import COUNTS, TAG
from tallymill.functions.measures import ACTIVITIES, METRICS
from tallymill.operators.git_output import CATEGORIES
from tallymill.operators.pricing import rate_rows
from tallymill.sources.testdata import PATHS

ACTS = {"read": "click", "edit_write": "purchase", "search": "view", "web": "signup", "terminal": "error"}
UE = f"""
e0 AS (SELECT event_id AS source_offset, user_id, event_type, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 1000) AS BIGINT) AS b FROM events),
ue AS (SELECT source_offset, CASE WHEN user_id % 3 = 0 THEN 'local' ELSE 'codex' END AS provider_id, 'profile_' || user_id % 4 AS profile_id, 'session_' || user_id AS session_id,
  us // 1000000 AS timestamp_seconds, (us % 1000000) * 1000 AS timestamp_nanos,
  CASE event_type WHEN 'click' THEN 'gpt-5.6' WHEN 'view' THEN 'gpt-5.4-mini' WHEN 'purchase' THEN 'gpt-5.5' WHEN 'signup' THEN 'gpt-5-nano' ELSE 'unpriced-model' END AS model,
  CASE WHEN k % 10 = 0 THEN NULL ELSE 'proj_' || k % 7 END AS project_alias,
  CASE WHEN k % 11 = 0 THEN NULL ELSE b END AS input_tokens, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(floor(b / 3) AS BIGINT) END AS cached_tokens,
  CAST(floor(b / 5) AS BIGINT) AS output_tokens, CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(floor(b / 20) AS BIGINT) END AS reasoning_tokens,
  CASE WHEN k % 19 = 0 THEN NULL ELSE b + CAST(floor(b / 5) AS BIGINT) + CAST(floor(b / 20) AS BIGINT) END AS total_tokens,
  CASE k % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'priority' WHEN 3 THEN 'flex' END AS service_tier,
  CASE WHEN k % 11 = 0 THEN 'unavailable' WHEN b > 272000 THEN 'yes' ELSE 'no' END AS long_context, CAST(k % 23 = 0 AS BIGINT) AS fallback_model,
  CASE WHEN k % 5 = 0 THEN b * 7 END AS reported_cost_usd_micros,
  {", ".join(f"CAST(event_type = '{ACTS[a]}' AS BIGINT) AS activity_{a}" if a in ACTS else f"CAST(0 AS BIGINT) AS activity_{a}" for a in ACTIVITIES)} FROM e0)"""

AGGS = ", ".join(
    ["count(*) AS event_count", "CAST(sum(fallback_model) AS BIGINT) AS fallback_events"]
    + [f"count({c}) AS known_{c}, CAST(coalesce(sum({c}), 0) AS BIGINT) AS sum_{c}" for c in COUNTS]
    + [f"count(*) FILTER (long_context = '{v}') AS long_{v}" for v in ("yes", "no", "unavailable")]
    + [f"CAST(sum(activity_{a}) AS BIGINT) AS activity_{a}" for a in ACTIVITIES]
)
ZERO = AGGS.replace("CAST(sum(fallback_model) AS BIGINT)", "CAST(coalesce(sum(fallback_model), 0) AS BIGINT)")
for _a in ACTIVITIES:
    ZERO = ZERO.replace(f"CAST(sum(activity_{_a}) AS BIGINT)", f"CAST(coalesce(sum(activity_{_a}), 0) AS BIGINT)")
DIM = """
dim AS (SELECT *, 'all' AS dimension, '' AS dimension_value FROM ue UNION ALL SELECT *, 'model', model FROM ue UNION ALL SELECT *, 'project', coalesce(project_alias, '') FROM ue)"""


def _fingerprint() -> str:
    text = lambda c: f"unhex(printf('%08x', strlen({c}))) || encode({c})"
    count = lambda c: f"CASE WHEN {c} IS NULL THEN unhex('00') ELSE unhex('01') || unhex(printf('%016x', {c})) END"
    parts = [f"encode('{TAG}')", *map(text, ("provider_id", "profile_id", "session_id")), "unhex(printf('%016x', source_offset))", text("model"), *map(count, COUNTS)]
    return "sha256(" + " || ".join(parts) + ")"


TIER = "CASE WHEN service_tier IS NULL THEN 'standard_assumed' WHEN lower(service_tier) IN ('standard', 'default') THEN 'standard_reported' WHEN lower(service_tier) IN ('priority', 'fast') THEN 'priority' ELSE 'unknown' END"
CALC = """coalesce(input_tokens IS NOT NULL AND cached_tokens IS NOT NULL AND cached_tokens <= input_tokens AND CASE WHEN total_tokens IS NOT NULL
  THEN total_tokens >= input_tokens AND (output_tokens IS NULL OR reasoning_tokens IS NULL OR (output_tokens <= total_tokens - input_tokens AND reasoning_tokens = total_tokens - input_tokens - output_tokens))
  ELSE output_tokens IS NOT NULL AND reasoning_tokens IS NOT NULL END, false)"""
PRICED = f"""
pr AS (SELECT *, coalesce(project_alias, '') AS project, {TIER} AS tier, CASE long_context WHEN 'yes' THEN 'long' WHEN 'no' THEN 'short' ELSE 'unavailable' END AS context,
  CASE WHEN reported_cost_usd_micros IS NULL THEN 'missing' ELSE 'present' END AS reported_state, {CALC} AS ok FROM ue),
pb AS (SELECT *, CASE WHEN ok THEN input_tokens - cached_tokens ELSE 0 END AS un, CASE WHEN ok THEN cached_tokens ELSE 0 END AS ca,
  CASE WHEN ok THEN coalesce(total_tokens - input_tokens, output_tokens + reasoning_tokens) ELSE 0 END AS bi FROM pr)"""
PKEYS = "model, tier, context, reported_state"
PRANK = ", ".join(f"{c} DESC NULLS LAST" for c in ("event_count", "calculable_events", "reported_events", "uncached", "cached", "billable", "reported_cost")) + f", {PKEYS}"
PSUMS = """count(*) AS event_count, CAST(sum(CAST(ok AS BIGINT)) AS BIGINT) AS calculable_events, count(reported_cost_usd_micros) AS reported_events,
  CAST(sum(un) AS BIGINT) AS uncached, CAST(sum(ca) AS BIGINT) AS cached, CAST(sum(bi) AS BIGINT) AS billable, CAST(sum(reported_cost_usd_micros) AS BIGINT) AS reported_cost"""


#: The minutes from the first hour of the events to the end of the last.
MINUTES = "SELECT unnest(range(a, z, 60)) AS timestamp_seconds FROM (SELECT min(epoch_us(ts)) // 3600000000 * 3600 AS a, max(epoch_us(ts)) // 3600000000 * 3600 + 3600 AS z FROM events)"


def _cost(target: str, mode: str, start: int, end: int) -> str:
    rates = ", ".join(f"('{n}', '{t}', '{c}', {u}, {a}, {o})" for n, _, t, c, u, a, o in rate_rows())
    take = {"auto": "reported_cost IS NOT NULL", "calculated": "false", "reported": "true"}[mode]
    return f"""WITH {UE}, {PRICED}, rates(model, tier_class, context, ur, cr, o_r) AS (VALUES {rates}),
rows_ AS (SELECT {target}, {PKEYS}, {PSUMS} FROM (SELECT *, (timestamp_seconds - {start}) // 86400 AS day, model AS target FROM pb WHERE timestamp_seconds >= {start} AND timestamp_seconds < {end}) GROUP BY ALL),
r AS (SELECT rows_.*, ur, EXISTS (SELECT 1 FROM rates x WHERE x.model = rows_.model) AS known,
  CAST(uncached AS HUGEINT) * ur + CAST(cached AS HUGEINT) * cr + CAST(billable AS HUGEINT) * o_r AS num
  FROM rows_ LEFT JOIN rates ON rates.model = rows_.model AND rates.context = rows_.context AND rates.tier_class = CASE WHEN tier = 'priority' THEN 'priority' WHEN tier <> 'unknown' THEN 'standard' END),
s AS (SELECT *, CASE WHEN calculable_events = 0 THEN 'token_basis_unavailable' WHEN NOT known THEN 'model_unpriced' WHEN tier = 'unknown' THEN 'tier_unknown' WHEN context = 'unavailable' THEN 'context_unavailable' WHEN ur IS NULL THEN 'tier_context_unsupported' END AS reason, {take} AS take FROM r),
t AS (SELECT *, take AND reported_cost IS NOT NULL AS paid, NOT take AND reason IS NULL AS rated, CASE WHEN reason IS NULL THEN (num + 500000) // 1000000 END AS calc FROM s),
u AS (SELECT *, CASE WHEN take AND reported_cost IS NULL THEN 'reported_cost_missing' WHEN NOT take AND reason IS NOT NULL THEN reason WHEN rated AND calculable_events < event_count THEN 'token_basis_unavailable' END AS why FROM t),
g AS (SELECT {target}, sum(CASE WHEN paid THEN CAST(reported_cost AS HUGEINT) * 1000000 WHEN rated THEN num END) AS n, CAST(sum(event_count) AS BIGINT) AS total_events,
  CAST(sum(CASE WHEN rated THEN calculable_events ELSE 0 END) AS BIGINT) AS priced_events, CAST(sum(CASE WHEN paid THEN reported_events ELSE 0 END) AS BIGINT) AS reported_events,
  CAST(sum(CASE WHEN rated AND tier = 'standard_assumed' THEN calculable_events ELSE 0 END) AS BIGINT) AS assumed_events,
  CAST(sum(CASE WHEN paid THEN 0 WHEN rated THEN event_count - calculable_events ELSE event_count END) AS BIGINT) AS unpriced_events,
  CAST(sum(CASE WHEN reported_events = event_count AND calculable_events = event_count AND abs(reported_cost - calc) > 10000 AND abs(reported_cost - calc) * 100 > greatest(reported_cost, calc) * 2 THEN event_count ELSE 0 END) AS BIGINT) AS conflict_events,
  coalesce(array_to_string(list_slice(list_sort(list(DISTINCT why || ':' || model) FILTER (why IS NOT NULL)), 1, 32), ','), '') AS missing FROM u GROUP BY {target}),
h AS (SELECT *, CASE WHEN priced_events + reported_events > 0 THEN CAST((coalesce(n, 0) + 500000) // 1000000 AS BIGINT) END AS amount FROM g)
SELECT {target}, total_events, priced_events, reported_events, assumed_events, unpriced_events, conflict_events, missing, amount,
  CASE WHEN priced_events + reported_events = 0 THEN 'unavailable' WHEN unpriced_events = 0 THEN CASE WHEN amount = 0 THEN 'zero' ELSE 'complete' END ELSE 'partial' END AS availability,
  CASE WHEN priced_events > 0 AND reported_events > 0 THEN 'mixed' WHEN priced_events > 0 THEN 'calculated' WHEN reported_events > 0 THEN 'reported' ELSE 'none' END AS composition FROM h"""


def batch_sql(target: str, expr: str, where: str) -> str:
    """`target` names one column, or several with `expr` the same."""
    named = expr if expr == target else f"{expr} AS {target}"
    return f"""WITH {UE}, {PRICED}, b AS (SELECT {named}, {PKEYS}, {PSUMS} FROM pb {where} GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY {PRANK}) AS key_rank FROM b), kept AS (SELECT * FROM k WHERE key_rank <= 512 ORDER BY key_rank, {target} LIMIT 512)
SELECT {target}, target_events, coalesce(shown_events, 0) AS shown_events, coalesce(keys, 0) AS keys, target_events - coalesce(shown_events, 0) AS omitted_events
FROM (SELECT {target}, CAST(sum(event_count) AS BIGINT) AS target_events FROM b GROUP BY {target}) LEFT JOIN (SELECT {target}, CAST(sum(event_count) AS BIGINT) AS shown_events, count(*) AS keys FROM kept GROUP BY {target}) USING ({target})"""


def _path_case() -> str:
    kind = dict(zip(PATHS, ("product_code", "test", "docs_spec", "vendor_generated", "schema_migration", "asset", "product_code", "other", "vendor_generated", "product_code"), strict=True))
    return "CASE l_partkey % 10 " + " ".join(f"WHEN {i} THEN '{kind[p]}'" for i, p in enumerate(PATHS)) + " END"


GIT = f"""gc AS (SELECT CAST(l_suppkey % 5 AS BIGINT) AS repository_id, CAST(l_orderkey AS BIGINT) AS commit_id, {_path_case()} AS category, CAST(l_quantity AS BIGINT) AS added,
  CAST(floor(l_quantity / 2) AS BIGINT) AS removed, l_orderkey % 17 = 0 AS is_merge, epoch_us(l_shipdate) // 86400000000 AS day_index FROM lineitem),
dc AS (SELECT repository_id, day_index, category, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM gc WHERE NOT is_merge GROUP BY ALL)"""


def lots_sql(observed: bool) -> str:
    more = "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END" if observed else "0"
    first = "used" if observed else "available"
    where = "o_orderkey % 3 <> 0" if observed else "o_orderkey % 4 <> 1"
    return f"""SELECT CAST(o_orderkey AS BIGINT) AS lot_id, 'scope_' || o_custkey % 8 AS scope_id, CAST(round(o_totalprice * 100) AS BIGINT) % 1000 + {more} AS quantity,
  CASE WHEN o_orderkey % 7 = 0 THEN '{first}' WHEN o_orderkey % 11 = 0 THEN 'expired' WHEN o_orderkey % 13 = 0 THEN 'ambiguous' ELSE 'available' END AS state,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(epoch_us(o_orderdate) // 1000 + 86400000 * (o_orderkey % 40) AS BIGINT) END AS expires_at_ms FROM orders WHERE {where}"""


REMIND = f"""lots AS ({lots_sql(False)}), rem AS (SELECT scope_id, lot_id, expires_at_ms, lead_seconds, 'in_app' AS channel, expires_at_ms - lead_seconds * 1000 AS due_at_ms
  FROM lots, (VALUES (CAST(604800 AS BIGINT)), (86400), (43200), (21600), (3600)) l(lead_seconds) WHERE state = 'available' AND expires_at_ms IS NOT NULL)"""



FINGERPRINTED = f"WITH {UE}, fpd AS (SELECT *, {_fingerprint()} AS fingerprint FROM ue)"


def statements(start: int, end: int, targets: list, scopes: list, now_ms: int) -> dict[str, str]:
    rng = f"timestamp_seconds >= {start} AND timestamp_seconds < {end}"
    days = ", ".join(f"({t}, {a}, {b})" for t, a, b in targets)
    local = "timezone('America/New_York', timezone('UTC', make_timestamp((timestamp_seconds // 60 * 60) * 1000000)))"
    hour, weekday = f"CAST(extract(hour FROM {local}) AS BIGINT)", f"CAST(isodow({local}) - 1 AS BIGINT)"
    time_keys = "bucket_width, bucket_start, provider_id, profile_id, dimension, dimension_value"
    wide = "(SELECT dim.*, w AS bucket_width, timestamp_seconds - ((timestamp_seconds % w) + w) % w AS bucket_start FROM dim, (VALUES (CAST(60 AS BIGINT)), (3600)) x(w))"
    rolled = lambda where="": f"WITH {UE}, {DIM} SELECT {time_keys}, {AGGS} FROM {wide} {where} GROUP BY ALL"
    sess = f"""WITH {UE}, {DIM}, so AS (SELECT provider_id, profile_id, session_id, dimension, dimension_value, {AGGS}, min(struct_pack(s := timestamp_seconds, n := timestamp_nanos)) AS a, max(struct_pack(s := timestamp_seconds, n := timestamp_nanos)) AS z FROM dim GROUP BY ALL),
ss AS (SELECT * EXCLUDE (a, z), {", ".join(f"CASE WHEN dimension = 'all' THEN {v}.{f} END AS {n}_{u}" for n, v in (("first", "a"), ("last", "z")) for u, f in (("seconds", "s"), ("nanos", "n")))} FROM so)"""
    metrics = ", ".join(METRICS)

    def broken_down(kind: str) -> str:
        keys = {"model": "model AS dimension_value", "project": "coalesce(project_alias, '') AS dimension_value", "provider": "provider_id", "profile": "provider_id, profile_id"}[kind]
        names = ", ".join(k.split(" AS ")[-1] for k in keys.split(", ") if "coalesce" not in k and "''" not in k) or "dimension_value"
        names = {"model": "dimension_value", "project": "dimension_value"}.get(kind, names)
        return f"SELECT {keys}, {AGGS} FROM ue WHERE {rng} GROUP BY {names} ORDER BY sum_total_tokens DESC, event_count DESC, {names} LIMIT 256"

    def rhythm(key: str, n: int) -> str:
        zero = ", ".join(f"coalesce({m}, 0) AS {m}" for m in METRICS)
        return f"WITH {UE}, f AS (SELECT {key} AS cell, {AGGS} FROM ue WHERE {rng} GROUP BY 1) SELECT cell, {zero} FROM (SELECT range AS cell FROM range({n})) LEFT JOIN f USING (cell)"

    zero = ", ".join(f"coalesce({m}, 0) AS {m}" for m in METRICS)
    in_scope = " OR ".join(f"(provider_id = '{p}' AND profile_id = '{q}')" for p, q in scopes)
    avail = lambda c: f"CASE WHEN event_count = 0 OR known_{c} = event_count THEN 'known' WHEN known_{c} = 0 THEN 'unavailable' ELSE 'partial' END AS {c}"
    page = "timestamp_seconds, timestamp_nanos, fingerprint, session_id, total_tokens"
    newest = "timestamp_seconds DESC, timestamp_nanos DESC, fingerprint DESC"
    fp = FINGERPRINTED
    s_page = "provider_id, profile_id, session_id, last_seconds, last_nanos, event_count, sum_total_tokens"
    s_order = "last_seconds DESC, last_nanos DESC, provider_id, profile_id, session_id"
    fresh = "CASE WHEN age < 0 THEN 'unavailable' WHEN age <= 1200 THEN 'fresh' WHEN age <= 7200 THEN 'aging' ELSE 'stale' END"
    last = f"WITH {UE}, la AS (SELECT session_id, provider_id, 1706659200 - max(timestamp_seconds) AS age FROM ue GROUP BY ALL)"
    changed = "CAST(quantity IS DISTINCT FROM oq AS INT) + CAST(state IS DISTINCT FROM os AS INT) + CAST(expires_at_ms IS DISTINCT FROM oe AS INT)"

    def reconcile(complete: bool) -> str:
        missing = "CASE WHEN os IN ('used', 'expired') THEN 'retired_terminal' WHEN os = 'ambiguous' THEN NULL ELSE 'disappeared_ambiguous' END" if complete else "NULL"
        return f"""WITH cur AS ({lots_sql(False)}), obs AS ({lots_sql(True)}), j AS (SELECT coalesce(o.lot_id, c.lot_id) AS lot_id, coalesce(o.scope_id, c.scope_id) AS scope_id, c.lot_id AS was, o.lot_id AS seen, o.quantity, o.state, o.expires_at_ms, c.quantity AS oq, c.state AS os, c.expires_at_ms AS oe
  FROM cur c FULL JOIN obs o ON c.lot_id = o.lot_id), k AS (SELECT *, {changed} AS n FROM j),
l AS (SELECT *, CASE WHEN was IS NULL THEN 'awarded' WHEN seen IS NULL THEN {missing} WHEN n = 0 THEN NULL WHEN n > 1 THEN 'corrected' WHEN quantity IS DISTINCT FROM oq THEN 'quantity_changed'
  WHEN state IS DISTINCT FROM os THEN CASE WHEN os = 'ambiguous' THEN 'reappeared' ELSE 'state_changed' END ELSE 'expiry_changed' END AS kind FROM k)
SELECT scope_id, row_number() OVER (PARTITION BY scope_id ORDER BY seen IS NULL, lot_id) AS sequence, lot_id, kind FROM l WHERE kind IS NOT NULL"""

    out = {
        "a0_usage_events": f"WITH {UE} SELECT * FROM ue",
        "c2_event_identity": f"{fp} SELECT source_offset, fingerprint, 'event_' || substr(fingerprint, 1, 20) AS event_id FROM fpd",
        "a2_time_rollup": rolled(),
        "a4_merged_rollup": rolled(),
        "a11_retracted_rollup": rolled("WHERE source_offset % 3 <> 0"),
        "a5_session_rollup": f"{sess} SELECT * FROM ss",
        "a9_price_time_rollup": f"WITH {UE}, {PRICED} SELECT timestamp_seconds - ((timestamp_seconds % 3600) + 3600) % 3600 AS bucket_start, provider_id, profile_id, project, {PKEYS}, {PSUMS} FROM pb GROUP BY ALL",
        "a10_price_session_rollup": f"WITH {UE}, {PRICED} SELECT provider_id, profile_id, session_id, project, {PKEYS}, {PSUMS} FROM pb GROUP BY ALL",
        "u1_overview": f"WITH {UE} SELECT {ZERO} FROM ue WHERE {rng}",
        "u2_scoped_overview": f"WITH {UE} SELECT {ZERO} FROM ue WHERE {rng} AND ({in_scope})",
        "u3_daily_series": f"WITH {UE}, t(target, a, b) AS (VALUES {days}), f AS (SELECT CAST(target AS BIGINT) AS target, {AGGS} FROM ue JOIN t ON timestamp_seconds >= a AND timestamp_seconds < b GROUP BY 1) SELECT CAST(t.target AS BIGINT) AS target, {zero} FROM t LEFT JOIN f ON t.target = f.target",
        "u5_rhythm_hours": rhythm(hour, 24),
        "u5_rhythm_weekdays": rhythm(weekday, 7),
        "u5_rhythm_cells": rhythm(f"{weekday} * 24 + {hour}", 168),
        "d7_hour_exposure": f"SELECT {hour} AS hour, count(*) AS elapsed_minutes FROM ({MINUTES}) GROUP BY 1",
        "u7_lifetime": f"WITH {UE} SELECT {ZERO} FROM ue",
        "u8_availability": f"WITH {UE} SELECT dimension_value, {', '.join(map(avail, ('input_tokens', 'cached_tokens', 'output_tokens', 'total_tokens')))} FROM ({broken_down('model')})",
        "u10_activity_page": f"{fp} SELECT {page} FROM fpd ORDER BY {newest} LIMIT 200",
        "u10_activity_cursor": f"{fp} SELECT {page} FROM fpd WHERE timestamp_seconds < 1705000000 ORDER BY {newest} LIMIT 100",
        "u12_session_page": f"{sess} SELECT {s_page} FROM ss WHERE dimension = 'all' ORDER BY {s_order} LIMIT 100",
        "u12_session_cursor": f"{sess} SELECT {s_page} FROM ss WHERE dimension = 'all' AND (last_seconds < 1706500000 OR (last_seconds = 1706500000 AND last_nanos = 0)) ORDER BY {s_order} LIMIT 100",
        "u13_session_detail": f"{sess} SELECT * FROM ss WHERE provider_id = 'local' AND profile_id = 'profile_0' AND session_id = 'session_0' AND dimension = 'all'",
        "u14_session_models": f"{sess} SELECT dimension_value, {metrics} FROM ss WHERE provider_id = 'local' AND profile_id = 'profile_0' AND session_id = 'session_0' AND dimension = 'model'",
        "p1_price_basis": f"WITH {UE}, {PRICED} SELECT {PKEYS}, {PSUMS} FROM pb WHERE {rng} GROUP BY ALL ORDER BY {PRANK} LIMIT 512",
        "p3_price_batch_days": batch_sql("day", f"(timestamp_seconds - {start}) // 86400", f"WHERE {rng}"),
        "p4_price_batch_projects": batch_sql("project", "project", f"WHERE {rng}"),
        "p5_price_batch_sessions": batch_sql("provider_id, profile_id, session_id", "provider_id, profile_id, session_id", ""),
        "p6_catalogue": f"WITH {UE} SELECT * FROM (SELECT DISTINCT model AS name FROM ue) LEFT JOIN (VALUES " + ", ".join(f"('{n}', '{m}', '{t}', '{c}', CAST({u} AS BIGINT), CAST({a} AS BIGINT), CAST({o} AS BIGINT))" for n, m, t, c, u, a, o in rate_rows()) + ") v(name, canonical, tier_class, context, uncached_rate, cached_rate, output_rate) USING (name)",
        "p12_cost_auto_days": _cost("day", "auto", start, end),
        "p12_cost_calculated_models": _cost("target", "calculated", start, end),
        "p12_cost_reported_days": _cost("day", "reported", start, end),
        "c6_canonical_pick": f"{fp}, c AS (SELECT fingerprint, profile_id, f.file_key, source_offset % 2 AS generation, source_offset, total_tokens FROM fpd, (VALUES ('a'), ('b')) f(file_key)) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY profile_id, file_key, generation, source_offset) = 1",
        "b1_reconcile": reconcile(True),
        "b1_reconcile_partial": reconcile(False),
        "b4_reminders": f"WITH {REMIND} SELECT * FROM rem",
        "b5_due_reminders": f"WITH {REMIND} SELECT scope_id, lot_id, channel, min(lead_seconds) AS lead_seconds, min(expires_at_ms) AS expires_at_ms FROM rem WHERE due_at_ms <= {now_ms} AND expires_at_ms > {now_ms} GROUP BY ALL",
        "b8_fefo": f"{lots_sql(False)} ORDER BY expires_at_ms NULLS LAST, lot_id LIMIT 256",
        "b9_nearest_expiry": f"WITH lots AS ({lots_sql(False)}) SELECT scope_id, min(expires_at_ms) AS expires_at_ms, (min(struct_pack(e := expires_at_ms, l := lot_id))).l AS lot_id, count(*) AS lots FROM lots WHERE state = 'available' AND expires_at_ms IS NOT NULL GROUP BY 1",
        "g1_day_categories": f"WITH {GIT} SELECT * FROM dc",
        "g3_days": f"WITH {GIT}, pc AS (SELECT repository_id, day_index, commit_id, bool_or(is_merge) AS m, sum(added) AS a, sum(removed) AS r FROM gc GROUP BY ALL), d AS (SELECT repository_id, day_index, count(*) AS commits, count(*) FILTER (m) AS merge_commits, CAST(sum(CASE WHEN m THEN 0 ELSE a END) AS BIGINT) AS added, CAST(sum(CASE WHEN m THEN 0 ELSE r END) AS BIGINT) AS removed FROM pc GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY repository_id) > 400 AS truncated FROM d QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY day_index DESC) <= 400",
        "g5_range_categories": f"WITH {GIT}, s AS (SELECT repository_id, category, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM dc WHERE day_index BETWEEN 9000 AND 9400 GROUP BY ALL) SELECT repository_id, category, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM (SELECT DISTINCT repository_id FROM dc) CROSS JOIN (SELECT unnest({list(CATEGORIES)}) AS category) LEFT JOIN s USING (repository_id, category)",
        "g10_efficiency": f"WITH {GIT}, ln AS (SELECT 'proj_' || repository_id AS project, CAST(sum(added) AS BIGINT) AS lines FROM dc WHERE category = 'product_code' GROUP BY 1), co AS ({_cost('project', 'auto', start, end)}) SELECT project, amount, lines, CASE WHEN lines > 0 AND amount IS NOT NULL THEN CAST((CAST(amount AS HUGEINT) * 100 + lines // 2) // lines AS BIGINT) END AS per_100_lines FROM co LEFT JOIN ln USING (project)",
        "s19_quota_windows": """WITH s AS (SELECT 'account_' || user_id % 4 AS account_id, event_type AS limit_id, epoch_us(ts) // 1000 AS observed_at_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
            w AS (SELECT account_id, observed_at_ms, limit_id || '.primary.' || CASE WHEN k % 4 <> 0 THEN '300' ELSE 'unknown' END AS window_id, k % 103 * 10000 AS used_ppm, CASE WHEN k % 4 <> 0 THEN CAST(18000 AS BIGINT) END AS duration_seconds, CASE WHEN k % 5 <> 0 THEN (observed_at_ms // 1000 + 600) * 1000 END AS advertised_resets_at_ms FROM s WHERE k % 103 <= 100
              UNION ALL SELECT account_id, observed_at_ms, limit_id || '.secondary.10080', k % 100 * 10000, 604800, NULL FROM s WHERE k % 103 <= 100 AND k % 3 <> 0) SELECT * FROM w""",
        "b13_removable_changes": "SELECT 'scope_' || o.user_id % 8 AS scope_id, o.user_id AS lot_id, o.event_id AS sequence FROM events o WHERE EXISTS (SELECT 1 FROM events n WHERE n.user_id = o.user_id AND n.event_id > o.event_id)",
        "b14_rehydrated_lots": "SELECT 'scope_' || user_id % 8 AS scope_id, user_id AS lot_id, max(event_id) AS lot_revision, max(event_id) % 10 AS quantity, 'ambiguous' AS state FROM events WHERE user_id % 5 <> 0 AND user_id % 3 <> 0 GROUP BY user_id HAVING arg_max(event_type, event_id) = 'error'",
        "b15_due_rebuilt": f"WITH {REMIND} SELECT * FROM rem r WHERE NOT EXISTS (SELECT 1 FROM rem d WHERE d.lot_id = r.lot_id AND d.scope_id = r.scope_id AND d.lot_id % 5 = 0 AND d.lead_seconds = 86400 AND d.lead_seconds <= r.lead_seconds)",
        "a13_legacy_events": f"WITH {UE} SELECT source_offset, CASE WHEN source_offset % 5 < 3 AND profile_id = 'profile_' || source_offset % 5 THEN 'codex' ELSE 'unknown' END AS provider_id, profile_id, 'f' || source_offset % 5 AS selected_file_key FROM ue",
        "u11_legacy_page": f"{fp} SELECT {page}, CASE WHEN source_offset % 5 < 3 AND profile_id = 'profile_' || source_offset % 5 THEN 'codex' ELSE 'unknown' END AS provider_id FROM fpd ORDER BY {newest} LIMIT 200",
        # the fold itself, sample by sample: u, m and o are the unit, its maximum and the observation that reached it
        "x1_model_shares": f"WITH {UE} SELECT dimension_value, CAST(CAST(sum_total_tokens AS HUGEINT) * 1000000 // max(sum_total_tokens) OVER () AS BIGINT) AS share_ppm FROM ({broken_down('model')})",
        "x2_cache_hits": f"WITH {UE} SELECT dimension_value, CASE WHEN sum_input_tokens > 0 THEN CAST(CAST(sum_cached_tokens AS HUGEINT) * 1000000 // sum_input_tokens AS BIGINT) END AS cache_hit_ppm FROM ({broken_down('model')})",
        "t1_session_freshness": f"{last} SELECT session_id, {fresh} AS freshness FROM la",
        "t4_worst_freshness": f"{last} SELECT provider_id, list_extract(['fresh', 'aging', 'stale', 'unavailable'], max(list_position(['fresh', 'aging', 'stale', 'unavailable'], {fresh}))) AS worst FROM la GROUP BY 1",
        "t9_prunable_scans": "SELECT 'scope_' || user_id % 16 AS scope_id, epoch_us(ts) AS started_at, event_id AS scan_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts DESC, event_id DESC) > 32",
    }
    return out | {f"u4_breakdown_{k}": f"WITH {UE} {broken_down(k)}" for k in ("model", "project", "provider", "profile")}
