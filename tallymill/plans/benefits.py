"""Benefit inventory and reminders: registered queries and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill.functions.checkpoints import shared_folder
from tallymill.operators import benefit
from tallymill.plans import batches
from tallymill.plans.oracle import REMIND, lots_sql
from tallymill.sources import testdata
from tallymill.streaming import reminders

NOW_MS = 807_000_000_000
OVERVIEW_MS = 912_000_000_000
#: Moments of the clock in the streamed reminders.
CLOCK = (NOW_MS - 90_000_000, NOW_MS - 3_000_000, NOW_MS, NOW_MS + 700_000_000)


def _lots(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, benefit.KINDS)), (F.col("lot_id") % 4 + 1).cast("int"))
    return testdata.benefit_lots(spark, sf_dir, False).withColumn("kind", kind)


def _pending(spark, sf_dir):
    return benefit.schedule(testdata.benefit_lots(spark, sf_dir, False)).withColumn("lot_revision", F.col("lot_id") % 3)


def _receipts(spark, sf_dir):
    return _pending(spark, sf_dir).filter("lot_id % 5 = 0 AND lead_seconds = 43200").select("scope_id", "lot_id", "lot_revision", "channel", "lead_seconds")


def _deliveries(spark, sf_dir):
    got = benefit.process_due(_pending(spark, sf_dir), _receipts(spark, sf_dir), NOW_MS)[0]
    return got.withColumn("delivery_id", F.concat_ws("-", "scope_id", "lot_id", "lead_seconds"))


def _clocked(spark, sf_dir):
    """Reminders and receipts as a stream: those of odd lots come with the first tick, the others with the third."""
    rows = _pending(spark, sf_dir)
    given = _receipts(spark, sf_dir).withColumns({"due_at_ms": F.lit(None).cast("bigint"), "expires_at_ms": F.lit(None).cast("bigint")})
    every = rows.select(*given.columns).unionByName(given)
    columns = [c.split()[0] for c in reminders.SCHEMA.split(", ")]
    tick = spark.range(1).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in reminders.SCHEMA.split(", ")[1:]])
    some = (every.filter("lot_id % 2 = 1"), every.limit(0), every.filter("lot_id % 2 = 0"), every.limit(0))
    frames = [some[k].unionByName(tick, True).withColumn("at", F.timestamp_millis(F.lit(at))).select(*columns) for k, at in enumerate(CLOCK)]
    store = reminders.ReminderStore(spark, f"{shared_folder(spark)}/reminders-{uuid.uuid4().hex}")
    batches.applied(spark, frames, store.apply)
    return store.told()


def _sent(spark, sf_dir):
    return _clocked(spark, sf_dir).filter("sent").select("now_ms", *reminders.KEY, "lead_seconds", "expires_at_ms", "due_at_ms")


def _seen(spark, sf_dir):
    d = _deliveries(spark, sf_dir)
    return d, d.filter("lot_id % 2 = 0").select("delivery_id")


def _status(spark, sf_dir):
    changes = benefit.reconcile(testdata.benefit_lots(spark, sf_dir, False), testdata.benefit_lots(spark, sf_dir, True))
    scopes = changes.sparkSession.range(12).select(F.concat(F.lit("scope_"), "id").alias("scope_id"), "id")
    states = scopes.filter("id <> 3").select("scope_id", F.concat(F.lit("o"), "id").alias("last_observation_id"), (F.lit(1000) + F.col("id") % 2 * 100).alias("last_observed_at_ms"))
    observations = scopes.select("scope_id", F.when(F.col("id") % 4 == 2, F.concat(F.lit("o"), "id")).when(F.col("id") == 8, "o8").otherwise("new").alias("observation_id"), F.lit(1050).alias("observed_at_ms"))
    return benefit.observation_status(states, observations, changes)


def _revisions(spark, sf_dir):
    c = testdata.benefit_changes(spark, sf_dir)
    return c, c.select("scope_id", "lot_id", F.col("before_revision").alias("lot_revision"), (F.col("before_revision") % 10).alias("quantity")).filter("lot_revision % 7 <> 0")


def _page(spark, sf_dir):
    return benefit.change_page(*_revisions(spark, sf_dir), "scope_3", 60).select("sequence", "lot_id", "kind", "before_quantity", "after_quantity")


def _orphans(spark, sf_dir):
    changes, revisions = _revisions(spark, sf_dir)
    some = lambda r: revisions.filter(F.col("lot_revision") % 11 == r).select("scope_id", "lot_id", "lot_revision")
    return benefit.orphan_revisions(revisions, some(0), changes.filter("sequence % 3 = 0"), some(1), some(2)).select("scope_id", "lot_id", "lot_revision")


def _removable(spark, sf_dir):
    d, acknowledged = _seen(spark, sf_dir)
    current = d.filter("lot_id % 6 <> 0").select("scope_id", "lot_id", "lot_revision").distinct()
    return benefit.removable_deliveries(d, acknowledged, current).select("delivery_id")


def _overview_status(spark, sf_dir):
    """Scopes observed at the last expiry of their lots, the odd ones of partial quality."""
    lots = testdata.benefit_lots(spark, sf_dir, False)
    seen = lots.groupBy("scope_id").agg(F.max("expires_at_ms").alias("observed_at_ms"))
    odd = F.substring("scope_id", -1, 1).cast("int") % 2 == 1
    states = seen.withColumns({"fresh_until_ms": F.col("observed_at_ms") + 1000, "stale_after_ms": F.col("observed_at_ms") + 2_000_000_000, "quality": F.when(odd, "partial").otherwise("authoritative")})
    return benefit.overview_status(lots, states, OVERVIEW_MS)


def _profiles(spark, sf_dir):
    scopes = testdata.benefit_lots(spark, sf_dir, False).select("scope_id").distinct()
    own = spark.createDataFrame([("scope_1", [7200, 60]), ("scope_4", [])], "scope_id string, leads array<long>")
    return benefit.profiles(scopes, own, [86_400, 3600])


def _replaced(spark, sf_dir):
    lots = testdata.benefit_lots(spark, sf_dir, False)
    return benefit.replace_profile(lots, _profiles(spark, sf_dir), _receipts(spark, sf_dir).drop("lot_revision"))


QUERIES = {
    "b3_observation_status": _status,
    "b6_deliveries": _deliveries,
    "b6_counts": lambda s, d: benefit.process_due(_pending(s, d), _receipts(s, d), NOW_MS)[1],
    "b6_streamed_deliveries": _sent,
    "b6_streamed_counts": lambda s, d: reminders.counts(_clocked(s, d)),
    "b7_unacknowledged": lambda s, d: benefit.unacknowledged(*_seen(s, d)).select("delivery_id"),
    "b8_fefo_of_scope": lambda s, d: benefit.first_expired_first(_lots(s, d), 256, "scope_2").select("lot_id", "kind", "expires_at_ms"),
    "b10_change_page": _page,
    "b11_overview": lambda s, d: benefit.overview(testdata.benefit_lots(s, d, False), s.range(10).select(F.concat(F.lit("scope_"), "id").alias("scope_id"))),
    "b11_overview_status": _overview_status,
    "b12_profiles": lambda s, d: _profiles(s, d).select("scope_id", F.array_join(F.transform("leads", lambda x: x.cast("string")), ",").alias("leads"), "inherited"),
    "b13_orphan_revisions": _orphans,
    "b13_removable_deliveries": _removable,
    "b16_replaced_profile": _replaced,
}

_PENDING = f"""{REMIND}, pe AS (SELECT *, lot_id % 3 AS lot_revision FROM rem), rc AS (SELECT * FROM pe WHERE lot_id % 5 = 0 AND lead_seconds = 43200),
bs AS (SELECT scope_id, lot_id, lot_revision, channel, min(lead_seconds) AS lead_seconds, min(expires_at_ms) AS expires_at_ms FROM pe WHERE due_at_ms <= {NOW_MS} AND expires_at_ms > {NOW_MS} GROUP BY ALL),
jd AS (SELECT bs.*, NOT EXISTS (SELECT 1 FROM rc WHERE rc.lot_id = bs.lot_id AND rc.lead_seconds <= bs.lead_seconds) AS sent FROM bs),
dl AS (SELECT * EXCLUDE (sent), expires_at_ms - lead_seconds * 1000 AS due_at_ms, scope_id || '-' || lot_id || '-' || lead_seconds AS delivery_id FROM jd WHERE sent)"""
_CHANGES = """
ch AS (SELECT 'scope_' || user_id % 8 AS scope_id, user_id AS lot_id, event_id AS sequence, CASE WHEN event_type = 'error' THEN 'retired_terminal' ELSE 'state_changed' END AS kind, event_id AS b, CASE WHEN event_type <> 'error' THEN event_id + 1 END AS a FROM events),
rv AS (SELECT scope_id, lot_id, b AS lot_revision, b % 10 AS quantity FROM ch WHERE b % 7 <> 0)"""
_CLOCKED = f"""{REMIND}, pe AS (SELECT *, lot_id % 3 AS lot_revision, CASE WHEN lot_id % 2 = 1 THEN 1 ELSE 3 END AS came FROM rem),
ck AS (SELECT * FROM (VALUES {', '.join(f'({k + 1}, CAST({at} AS BIGINT))' for k, at in enumerate(CLOCK))}) t(k, now_ms)),
tk AS (SELECT pe.*, (SELECT min(k) FROM ck WHERE k >= came AND ck.now_ms >= due_at_ms) AS k FROM pe),
tn AS (SELECT tk.*, now_ms FROM tk JOIN ck USING (k)),
bs AS (SELECT now_ms, scope_id, lot_id, lot_revision, channel, min(lead_seconds) FILTER (expires_at_ms > now_ms) AS lead_seconds, min(expires_at_ms) AS expires_at_ms, count(*) AS taken, count(*) FILTER (expires_at_ms <= now_ms) AS expired FROM tn GROUP BY ALL),
jd AS (SELECT *, lead_seconds < coalesce(least(CASE WHEN lot_id % 5 = 0 THEN 43200 END, min(lead_seconds) OVER (PARTITION BY lot_id, channel ORDER BY now_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1000000000) AS sent FROM bs)"""
_OLD, _NEW = lots_sql(False), lots_sql(True)
_RECONCILED = f"""o AS ({_OLD}), n AS ({_NEW}), bt AS (SELECT coalesce(n.scope_id, o.scope_id) AS scope_id, coalesce(n.lot_id, o.lot_id) AS lot_id, o.lot_id IS NULL AS fresh, n.lot_id IS NULL AS gone, o.state AS os,
  n.quantity IS DISTINCT FROM o.quantity OR n.state IS DISTINCT FROM o.state OR n.expires_at_ms IS DISTINCT FROM o.expires_at_ms AS differs FROM o FULL JOIN n ON n.lot_id = o.lot_id),
cg AS (SELECT scope_id FROM bt WHERE CASE WHEN fresh THEN true WHEN gone THEN os <> 'ambiguous' ELSE differs END)"""
SQL = {
    "b3_observation_status": f"""WITH {_RECONCILED}, s AS (SELECT range AS id, 'scope_' || range AS scope_id FROM range(12)), k AS (SELECT s.*, (SELECT count(*) FROM cg WHERE cg.scope_id = s.scope_id) AS n FROM s)
SELECT scope_id, CASE WHEN id <> 3 AND 1050 < 1000 + id % 2 * 100 THEN 'stale' WHEN (id % 4 = 2 OR id = 8) AND n = 0 THEN 'duplicate' WHEN id % 4 = 2 OR id = 8 THEN 'conflict' WHEN n > 0 THEN 'changed' ELSE 'freshness_only' END AS status FROM k""",
    "b6_deliveries": f"WITH {_PENDING} SELECT * FROM dl",
    "b6_counts": f"""WITH {_PENDING}, t AS (SELECT scope_id, count(*) AS taken, count(*) FILTER (expires_at_ms <= {NOW_MS}) AS expired FROM pe WHERE due_at_ms <= {NOW_MS} GROUP BY 1)
SELECT scope_id, taken, expired, (SELECT count(*) FROM jd WHERE jd.scope_id = t.scope_id AND sent) AS delivered, (SELECT count(*) FROM jd WHERE jd.scope_id = t.scope_id AND NOT sent) AS suppressed FROM t""",
    "b6_streamed_deliveries": f"WITH {_CLOCKED} SELECT now_ms, scope_id, lot_id, lot_revision, channel, lead_seconds, expires_at_ms, expires_at_ms - lead_seconds * 1000 AS due_at_ms FROM jd WHERE sent",
    "b6_streamed_counts": f"WITH {_CLOCKED} SELECT now_ms, scope_id, CAST(sum(taken) AS BIGINT) AS taken, CAST(sum(expired) AS BIGINT) AS expired, count(*) FILTER (sent) AS delivered, count(*) FILTER (NOT sent) AS suppressed FROM jd GROUP BY 1, 2",
    "b7_unacknowledged": f"WITH {_PENDING} SELECT delivery_id FROM dl WHERE lot_id % 2 <> 0",
    "b8_fefo_of_scope": f"WITH l AS ({_OLD}), k AS (SELECT *, lot_id % 4 AS r FROM l) SELECT lot_id, CASE r {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(benefit.KINDS))} END AS kind, expires_at_ms FROM k WHERE scope_id = 'scope_2' ORDER BY expires_at_ms NULLS LAST, r, lot_id LIMIT 256",
    "b10_change_page": f"""WITH {_CHANGES}, p AS (SELECT * FROM ch WHERE scope_id = 'scope_3' ORDER BY sequence DESC LIMIT 60)
SELECT sequence, lot_id, kind, (SELECT quantity FROM rv WHERE rv.lot_id = p.lot_id AND lot_revision = b) AS before_quantity, (SELECT quantity FROM rv WHERE rv.lot_id = p.lot_id AND lot_revision = a) AS after_quantity FROM p""",
    "b11_overview": f"WITH l AS ({_OLD}) SELECT 'scope_' || range AS scope_id, count(lot_id) AS lots, count(*) FILTER (state = 'available') AS available, min(expires_at_ms) AS nearest_ms FROM range(10) LEFT JOIN l ON scope_id = 'scope_' || range GROUP BY 1",
    "b11_overview_status": f"""WITH l AS ({_OLD}), s AS (SELECT scope_id, max(expires_at_ms) AS seen, CAST(right(scope_id, 1) AS INT) % 2 = 1 AS odd FROM l GROUP BY 1),
f AS (SELECT *, CASE WHEN seen IS NULL OR {OVERVIEW_MS} < seen THEN 3 WHEN {OVERVIEW_MS} <= seen + 1000 THEN 0 WHEN {OVERVIEW_MS} <= seen + 2000000000 THEN 1 ELSE 2 END AS f FROM s)
SELECT count(*) AS scopes, (SELECT count(*) FROM l) AS lots, min(seen) AS data_through_ms, ['fresh', 'aging', 'stale', 'unavailable'][max(f) + 1] AS freshness, CASE WHEN bool_or(odd) THEN 'partial' ELSE 'authoritative' END AS quality,
  CASE WHEN max(f) >= 2 THEN 'inventory_stale' ELSE '' END AS warnings, (SELECT count(*) FROM l) > 256 AS over FROM f""",
    "b12_profiles": f"WITH l AS ({_OLD}) SELECT DISTINCT scope_id, CASE scope_id WHEN 'scope_1' THEN '7200,60' WHEN 'scope_4' THEN '' ELSE '86400,3600' END AS leads, scope_id NOT IN ('scope_1', 'scope_4') AS inherited FROM l",
    "b13_orphan_revisions": f"WITH {_CHANGES} SELECT scope_id, lot_id, lot_revision FROM rv WHERE lot_revision % 11 > 2 AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.lot_id = rv.lot_id AND sequence % 3 = 0 AND (b = lot_revision OR a = lot_revision))",
    "b13_removable_deliveries": f"WITH {_PENDING} SELECT delivery_id FROM dl WHERE lot_id % 6 = 0",
    "b16_replaced_profile": f"""WITH {_PENDING}, w AS (SELECT l.scope_id, l.lot_id, l.expires_at_ms, unnest(CASE l.scope_id WHEN 'scope_1' THEN [7200, 60] WHEN 'scope_4' THEN CAST([] AS INTEGER[]) ELSE [86400, 3600] END) AS lead_seconds FROM lots l WHERE state = 'available' AND expires_at_ms IS NOT NULL)
SELECT scope_id, lot_id, expires_at_ms, CAST(lead_seconds AS BIGINT) AS lead_seconds, 'in_app' AS channel, expires_at_ms - CAST(lead_seconds AS BIGINT) * 1000 AS due_at_ms FROM w
WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.lot_id = w.lot_id AND rc.lead_seconds <= w.lead_seconds)""",
}
