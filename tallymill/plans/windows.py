"""Quota windows: registered queries, and the same in SQL as a fold sample by sample."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill.functions.checkpoints import shared_folder
from tallymill.operators import quota, status
from tallymill.plans import batches
from tallymill.sources import provider, testdata
from tallymill.streaming import quota as stream

NOW_MS = 1_706_000_000_000
ASKED = [("profile_1", "click"), ("profile_9", "click"), ("profile_0", "view"), ("profile_2", "error")]
_OUT = ("scope_id", "window_id", "observed_at_ms", "observation_id", "signal", "reset_kind", "allowance_change", "epoch", "sequence", "max_used_ppm", "transition_confidence", "occurred_at_ms", "after_ms", "at_or_before_ms")
_BEST = ("max_ppm_observation", "max_units", "max_units_observation", "max_unit_id")
_PAGE = ("sequence", "observed_at_ms", "reset_kind", "allowance_change", "pre_observation_id", "pre_used_ppm", "pre_observed_at_ms", "used_ppm")
_NOW = ("scope_id", "window_id", "observed_at_ms", "epoch", "sequence", "used_ppm", "max_used_ppm", "quality")


def _changes(spark, sf_dir):
    return quota.transitions(testdata.quota_samples(spark, sf_dir))


def _asked(spark, sf_dir):
    got = quota.requested(quota.current_windows(_changes(spark, sf_dir)), ASKED, NOW_MS)
    return got.select("place", "scope_id", "window_id", "observed_at_ms", "freshness", "quality")


def _whole(spark, sf_dir):
    quality = ("authoritative", "derived", "estimated", "partial", "conflict", "unknown")
    return _asked(spark, sf_dir).agg(F.min("observed_at_ms").alias("data_through_ms"), status.worst(F.col("freshness")).alias("freshness"), status.worst(F.col("quality"), quality).alias("quality"), F.count_if(F.col("observed_at_ms").isNull()).alias("missing"))


def _ids(spark, sf_dir):
    rows = _changes(spark, sf_dir)
    return rows.groupBy("scope_id", "window_id").agg(F.count_distinct("epoch_id").alias("epochs"), F.count_distinct("transition_id").alias("transitions"))


def _redundant(spark, sf_dir):
    samples = testdata.quota_samples(spark, sf_dir)
    samples = samples.withColumns({"used_ppm": F.col("used_ppm") - F.col("used_ppm") % 500_000, "reset_occurred_at_ms": F.lit(None).cast("bigint"), "used_units": F.lit(None).cast("bigint"), "remaining_ppm": F.lit(None).cast("bigint")})
    return quota.redundant(samples, quota.referenced(quota.transitions(samples)))


def _streamed(spark, sf_dir):
    """The samples as a stream in three batches by time, the first one's given again with the second."""
    samples = testdata.quota_samples(spark, sf_dir)
    day = F.floor((F.col("observed_at_ms") - 1_704_067_200_000) / 864_000_000)
    first, second, third = (samples.filter(c) for c in (day < 1, day == 1, day > 1))
    store = stream.WindowStore(spark, f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}")
    batches.applied(spark, [first, second.unionByName(first), third], store.apply)
    return store.told().withColumn("max_used_ppm", F.col("max_ppm")).select(*_OUT, *_BEST)


QUERIES = {
    "q1_streamed_transitions": _streamed,
    "q2_quota_transitions": lambda s, d: _changes(s, d).select(*_OUT),
    "q3_open_thresholds": lambda s, d: quota.transitions(testdata.quota_samples(s, d), (None, None, 200_000)).select(*_OUT),
    "q7_epoch_maxima": lambda s, d: quota.maxima(_changes(s, d)),
    "q8_ids": _ids,
    "q8_id_values": lambda s, d: _changes(s, d).select("scope_id", "window_id", "observed_at_ms", "epoch_id", "previous_epoch_id", "transition_id"),
    "q8_sequence_gaps": lambda s, d: quota.sequence_gaps(_changes(s, d)),
    "q9_current_windows": lambda s, d: quota.current_windows(_changes(s, d)).select(*_NOW),
    "q10_transition_page": lambda s, d: quota.transition_page(_changes(s, d), "profile_1", "click", 50).select(*_PAGE),
    "q11_requested": _asked,
    "q11_worst": _whole,
    "q12_redundant_samples": _redundant,
    "s20_credit_lots": lambda s, d: provider.credit_lots(testdata.reset_credits(s, d)),
}

_SAMPLES = """
q0 AS (SELECT *, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
sm AS (SELECT 'profile_' || user_id % 4 AS scope_id, event_type AS window_id, event_id AS observation_id, ms AS observed_at_ms, k * 7919 % 1000001 AS used_ppm, 1000000 - k * 7919 % 1000001 AS remaining_ppm,
  CASE WHEN k % 29 <> 0 THEN 1000 + k % 3 END AS capacity_units, ms // 86400000 * 86400000 + 86400000 AS advertised_resets_at_ms,
  CASE WHEN k % 31 = 0 THEN 'manual_or_banked' WHEN k % 37 = 0 THEN 'explicit_provider' ELSE 'none' END AS reset_evidence,
  CASE WHEN k % 6 = 0 THEN 'low' WHEN k % 47 = 0 THEN 'unknown' ELSE 'high' END AS confidence,
  CASE WHEN k % 41 = 0 THEN 'conflict' WHEN k % 43 = 0 THEN 'unknown' WHEN k % 5 = 0 THEN 'partial' ELSE 'authoritative' END AS quality,
  CASE WHEN event_type = 'view' THEN 'rolling' ELSE 'fixed' END AS semantics, CASE WHEN k % 23 <> 0 THEN 'e' || ms // 432000000 END AS provider_epoch_id,
  CASE WHEN event_id % 9 < 6 THEN 'tokens' ELSE 'requests' END AS unit_id, CASE WHEN event_id % 8 <> 0 THEN k * 7919 % 1000001 // 100 END AS used_units,
  CASE WHEN k % 3 = 0 THEN ms - 1000 * k END AS reset_occurred_at_ms, ms + 600000 AS fresh_until_ms, ms + 3600000 AS stale_after_ms FROM q0)"""


def _fold(source: str = "sm", fell: str = "used_ppm <= 100000 AND remaining_ppm >= 900000 AND pu - used_ppm >= 300000") -> str:
    """Sample by sample: the state holds the last sample, the epoch, the sequence and the maxima."""
    told = f"""CASE WHEN reset_evidence = 'manual_or_banked' THEN 'manual' WHEN provider_epoch_id <> pe THEN 'provider_epoch' WHEN reset_evidence IN ('explicit_provider', 'explicit_local') THEN 'explicit'
      WHEN semantics = 'fixed' AND quality NOT IN ('conflict', 'unknown') AND confidence NOT IN ('low', 'unknown') AND coalesce({fell}, false) AND (coalesce(used_ppm < pu, false) OR coalesce(remaining_ppm > pr, false))
        THEN CASE WHEN advertised_resets_at_ms > pa THEN 'threshold_advanced' WHEN advertised_resets_at_ms IS NULL OR pa IS NULL THEN 'threshold_unknown' END END"""
    return f"""
ac AS (SELECT *, row_number() OVER (PARTITION BY scope_id, window_id ORDER BY observed_at_ms) AS n FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY scope_id, window_id, observed_at_ms ORDER BY observation_id) = 1)),
st AS (
  SELECT ac.*, CAST(NULL AS VARCHAR) AS signal, CAST(0 AS BIGINT) AS epoch, CAST(NULL AS BIGINT) AS pu, CAST(NULL AS BIGINT) AS pa, CAST(NULL AS BIGINT) AS pm, CAST(NULL AS BIGINT) AS po, CAST(NULL AS VARCHAR) AS allowance_change,
    used_ppm AS max_ppm, CASE WHEN used_ppm IS NOT NULL THEN observation_id END AS max_ppm_observation, used_units AS max_units, CASE WHEN used_units IS NOT NULL THEN unit_id END AS max_unit_id, CASE WHEN used_units IS NOT NULL THEN observation_id END AS max_units_observation,
    CAST(NULL AS BIGINT) AS bo, CAST(NULL AS BIGINT) AS bu
  FROM ac WHERE n = 1
  UNION ALL
  SELECT t.* EXCLUDE (pr, pe, pc, pn, om, oo, ou, ox, ol, oe, pu, pa, pm, po, sig), sig AS signal, oe + CASE WHEN sig IS NOT NULL THEN 1 ELSE 0 END AS epoch, pu, pa, pm, po,
    CASE WHEN capacity_units IS NULL OR pc IS NULL THEN NULL WHEN unit_id <> pn THEN 'unit_changed' WHEN capacity_units > pc THEN 'increased' WHEN capacity_units < pc THEN 'decreased' END,
    CASE WHEN sig IS NOT NULL OR om IS NULL OR used_ppm > om THEN used_ppm ELSE om END, CASE WHEN sig IS NOT NULL OR om IS NULL OR used_ppm > om THEN CASE WHEN used_ppm IS NOT NULL THEN observation_id END ELSE oo END,
    CASE WHEN sig IS NOT NULL OR ou IS NULL THEN used_units WHEN used_units IS NULL THEN ou WHEN ox <> unit_id THEN NULL WHEN used_units > ou THEN used_units ELSE ou END,
    CASE WHEN sig IS NOT NULL OR ou IS NULL THEN CASE WHEN used_units IS NOT NULL THEN unit_id END WHEN used_units IS NULL THEN ox WHEN ox <> unit_id THEN NULL ELSE ox END,
    CASE WHEN sig IS NOT NULL OR ou IS NULL THEN CASE WHEN used_units IS NOT NULL THEN observation_id END WHEN used_units IS NULL THEN ol WHEN ox <> unit_id THEN NULL WHEN used_units > ou THEN observation_id ELSE ol END,
    oo, ol
  FROM (SELECT *, {told} AS sig FROM (
    SELECT ac.*, st.used_ppm AS pu, st.remaining_ppm AS pr, st.provider_epoch_id AS pe, st.advertised_resets_at_ms AS pa, st.observed_at_ms AS pm, st.observation_id AS po, st.capacity_units AS pc, st.unit_id AS pn,
      st.max_ppm AS om, st.max_ppm_observation AS oo, st.max_units AS ou, st.max_unit_id AS ox, st.max_units_observation AS ol, st.epoch AS oe
    FROM st JOIN ac ON ac.scope_id = st.scope_id AND ac.window_id = st.window_id AND ac.n = st.n + 1)) t),
tr AS (SELECT *, CASE WHEN signal IS NULL THEN NULL WHEN signal = 'manual' THEN 'manual_or_banked' WHEN signal = 'threshold_unknown' OR pa IS NULL THEN 'unknown'
    WHEN coalesce(CASE WHEN reset_occurred_at_ms > pm THEN reset_occurred_at_ms END, observed_at_ms) >= pa THEN 'scheduled' ELSE 'early' END AS reset_kind,
  CASE WHEN signal IS NOT NULL AND reset_occurred_at_ms > pm THEN reset_occurred_at_ms END AS occurred_at_ms FROM st),
qt AS (SELECT *, CASE WHEN moved THEN CASE WHEN signal = 'threshold_unknown' OR signal = 'threshold_advanced' AND quality = 'partial' THEN 'low' ELSE confidence END END AS transition_confidence,
  CASE WHEN moved AND occurred_at_ms IS NULL THEN pm END AS after_ms, CASE WHEN moved AND occurred_at_ms IS NULL THEN observed_at_ms END AS at_or_before_ms,
  CAST(sum(CAST(moved AS BIGINT)) OVER (PARTITION BY scope_id, window_id ORDER BY observed_at_ms) AS BIGINT) AS sequence, max_ppm AS max_used_ppm
  FROM (SELECT *, signal IS NOT NULL OR allowance_change IS NOT NULL AS moved FROM tr))"""


_ALL = f"WITH RECURSIVE {_SAMPLES}, {_fold()}"
_LONG = lambda *names: ", ".join(f"length(CAST({n} AS VARCHAR)) || ':' || {n}" for n in names)
_IDS = f"""fe AS (SELECT *, first_value(observation_id) OVER (PARTITION BY scope_id, window_id, epoch ORDER BY observed_at_ms) AS fo FROM qt),
ep AS (SELECT *, sha256(concat_ws('|', 'tallymill.quota.epoch', {_LONG("scope_id", "window_id", "fo")})) AS epoch_id FROM fe),
pe AS (SELECT *, lag(epoch_id) OVER (PARTITION BY scope_id, window_id ORDER BY observed_at_ms) AS previous_epoch_id, coalesce(reset_kind, 'allowance_changed') AS rk FROM ep),
tx AS (SELECT *, CASE WHEN moved THEN sha256(concat_ws('|', 'tallymill.quota.transition', {_LONG("scope_id", "window_id", "sequence", "rk", "previous_epoch_id", "epoch_id", "po", "observation_id")})) END AS transition_id FROM pe)"""
_FRESH = f"CASE WHEN observed_at_ms IS NULL OR {NOW_MS} < observed_at_ms THEN 'unavailable' WHEN {NOW_MS} <= fresh_until_ms THEN 'fresh' WHEN {NOW_MS} <= stale_after_ms THEN 'aging' ELSE 'stale' END"
_WANT = f"""{_ALL}, cw AS (SELECT * FROM qt QUALIFY row_number() OVER (PARTITION BY scope_id, window_id ORDER BY observed_at_ms DESC) = 1),
ask AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(ASKED))}) t(place, scope_id, window_id)),
got AS (SELECT place, ask.scope_id, ask.window_id, observed_at_ms, {_FRESH} AS freshness, coalesce(quality, 'unknown') AS quality FROM ask LEFT JOIN cw ON cw.scope_id = ask.scope_id AND cw.window_id = ask.window_id)"""
_ROUGH = f"""WITH RECURSIVE {_SAMPLES}, rs AS (SELECT * REPLACE (used_ppm - used_ppm % 500000 AS used_ppm, CAST(NULL AS BIGINT) AS reset_occurred_at_ms, CAST(NULL AS BIGINT) AS used_units, CAST(NULL AS BIGINT) AS remaining_ppm) FROM sm), {_fold('rs')},
nm AS (
  SELECT scope_id, window_id, first(observation_id ORDER BY observed_at_ms) AS o FROM qt GROUP BY scope_id, window_id, epoch UNION SELECT scope_id, window_id, last(observation_id ORDER BY observed_at_ms) FROM qt GROUP BY scope_id, window_id, epoch
  UNION SELECT scope_id, window_id, last(max_ppm_observation ORDER BY observed_at_ms) FROM qt GROUP BY scope_id, window_id, epoch UNION SELECT scope_id, window_id, last(max_units_observation ORDER BY observed_at_ms) FROM qt GROUP BY scope_id, window_id, epoch
  UNION SELECT scope_id, window_id, unnest([po, observation_id, bo, bu]) FROM qt WHERE moved)
SELECT scope_id, window_id, observation_id, observed_at_ms FROM rs a WHERE EXISTS (SELECT 1 FROM rs b WHERE b.scope_id = a.scope_id AND b.window_id = a.window_id AND (b.observed_at_ms > a.observed_at_ms OR b.observed_at_ms = a.observed_at_ms AND b.observation_id > a.observation_id)
  AND """ + " AND ".join(f"b.{c} IS NOT DISTINCT FROM a.{c}" for c in ("provider_epoch_id", "used_ppm", "remaining_ppm", "unit_id", "used_units", "capacity_units", "advertised_resets_at_ms", "quality", "semantics", "confidence", "reset_evidence", "reset_occurred_at_ms")) + """)
  AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.scope_id = a.scope_id AND nm.window_id = a.window_id AND nm.o = a.observation_id)"""

SQL = {
    "q2_quota_transitions": f"{_ALL} SELECT {', '.join(_OUT)} FROM qt",
    "q1_streamed_transitions": f"{_ALL} SELECT {', '.join((*_OUT, *_BEST))} FROM qt",
    "q3_open_thresholds": f"WITH RECURSIVE {_SAMPLES}, {_fold(fell='pu - used_ppm >= 200000')} SELECT {', '.join(_OUT)} FROM qt",
    "q7_epoch_maxima": f"{_ALL} SELECT scope_id, window_id, observed_at_ms, epoch, max_ppm, max_ppm_observation, max_units, max_units_observation, max_unit_id FROM qt",
    "q8_ids": f"{_ALL} SELECT scope_id, window_id, count(DISTINCT epoch) AS epochs, count(*) FILTER (moved) AS transitions FROM qt GROUP BY 1, 2",
    "q8_id_values": f"{_ALL}, {_IDS} SELECT scope_id, window_id, observed_at_ms, epoch_id, previous_epoch_id, transition_id FROM tx",
    "q8_sequence_gaps": f"{_ALL} SELECT scope_id, window_id, count(*) FILTER (moved) AS transitions, max(sequence) AS last, CAST(0 AS BIGINT) AS gaps FROM qt GROUP BY 1, 2",
    "q9_current_windows": f"{_ALL} SELECT {', '.join(_NOW)} FROM qt QUALIFY row_number() OVER (PARTITION BY scope_id, window_id ORDER BY observed_at_ms DESC) = 1",
    "q10_transition_page": f"{_ALL} SELECT sequence, observed_at_ms, reset_kind, allowance_change, po AS pre_observation_id, pu AS pre_used_ppm, pm AS pre_observed_at_ms, used_ppm FROM qt WHERE scope_id = 'profile_1' AND window_id = 'click' AND moved ORDER BY sequence DESC LIMIT 50",
    "q11_requested": f"{_WANT} SELECT * FROM got",
    "q11_worst": f"""{_WANT} SELECT min(observed_at_ms) AS data_through_ms, arg_max(freshness, list_position(['fresh', 'aging', 'stale', 'unavailable'], freshness)) AS freshness,
  arg_max(quality, list_position(['authoritative', 'derived', 'estimated', 'partial', 'conflict', 'unknown'], quality)) AS quality, count(*) FILTER (observed_at_ms IS NULL) AS missing FROM got""",
    "q12_redundant_samples": _ROUGH,
    "s20_credit_lots": """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, 'account_' || o_custkey % 16 AS account_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t FROM orders),
c AS (SELECT *, t // 2592000 AS day, CASE WHEN k % 4 = 0 THEN 'activated' WHEN k % 4 = 1 THEN 'activation_pending' WHEN k % 17 = 0 THEN 'ambiguous' ELSE 'available' END AS state FROM o)
SELECT account_id, day * 2592000000 AS observed_at_ms, sha256('tallymill.lot.detail|' || account_id || '|' || k) AS lot_id, CASE WHEN k % 13 = 0 THEN 'unknown' ELSE 'banked_rate_limit_reset' END AS kind, CAST(1 AS BIGINT) AS quantity, state,
  t * 1000 AS granted_at_ms, CASE WHEN k % 3 <> 0 THEN (t + 86400) * 1000 END AS expires_at_ms, CASE WHEN k % 13 <> 0 AND state <> 'ambiguous' THEN 'high' ELSE 'low' END AS confidence, 'provider_detail' AS detail_kind FROM c
UNION ALL SELECT DISTINCT account_id, day * 2592000000, sha256('tallymill.lot.rest|' || account_id), 'banked_rate_limit_reset', day % 3, 'available', NULL, NULL, 'medium', 'provider_aggregate' FROM c WHERE day % 3 > 0""",
}
