"""Replay lineage: registered queries, and the same in SQL as a fold along each session."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill.functions.checkpoints import shared_folder
from tallymill.operators import lineage
from tallymill.sources import testdata
from tallymill.streaming.lineage import ReplayStore

_OUT = (*lineage.KEY, "ordinal", "source_offset", "disposition")


def _seen(spark, sf_dir):
    return testdata.turn_observations(spark, sf_dir)


def _classes(spark, sf_dir, complete=True):
    return lineage.classify(_seen(spark, sf_dir), complete)


def _ancestors(spark, sf_dir):
    return lineage.ancestors(lineage.relations(_seen(spark, sf_dir)))


def _facts(spark, sf_dir):
    return lineage.parent_facts(_seen(spark, sf_dir)).select(*lineage.KEY[:2], "parent_session_id", "ordinal", "parent.source_offset", "parent.signature", "parent.strong")


def _materialized(spark, sf_dir):
    classes = _classes(spark, sf_dir)
    chosen = lineage.selection(classes).select("fingerprint", "source_offset")
    return lineage.materialize_selection(testdata.prior_events(spark, sf_dir), chosen, classes)


def late_batches(seen):
    """Observations in two batches whose relations are partly told by neither, and all relations by themselves.

    Forks of even conversations do not name their parents, each seventh conversation comes after its forks, and later turns
    come after all first ones.
    """
    kind, of = F.substring("session_id", 1, 1), F.floor(F.col("source_offset") / 100)
    untold = (kind != "s") & (of % 2 == 0)
    bare = seen.withColumns({"parent_session_id": F.when(~untold, F.col("parent_session_id")), "relation_conflict": ~untold & F.col("relation_conflict")})
    first = (F.col("ordinal") < 2) & ~((kind == "s") & (of % 7 == 0))
    relations = seen.select(*lineage.KEY, "parent_session_id", "relation_conflict").distinct()
    return bare.filter(first), bare.filter(~first), relations


def _late(spark, sf_dir):
    """The conversations in three batches, with parents after their children and relations last of all."""
    store = ReplayStore(spark, f"{shared_folder(spark)}/late-{uuid.uuid4().hex}", buckets=8)
    early, later, relations = late_batches(_seen(spark, sf_dir))
    store.apply(early, 0)
    store.apply(later, 1)
    store.apply(later.limit(0), 2, relations)
    return store.current().select(*_OUT)


QUERIES = {
    "r5_late_relations": _late,
    "l1_relations": lambda s, d: lineage.relations(_seen(s, d)),
    "l2_parent_facts": _facts,
    "l3_ancestors": _ancestors,
    "l4_fan_out": lambda s, d: lineage.fan_out(lineage.relations(_seen(s, d))),
    "l5_replay_classes": lambda s, d: _classes(s, d).select(*_OUT),
    "l5_replay_open": lambda s, d: _classes(s, d, False).select(*_OUT),
    "l7_materialized": _materialized,
    "l9_replay_quality": lambda s, d: lineage.replay_quality(_classes(s, d)),
    "c6_selection": lambda s, d: lineage.selection(_classes(s, d)).select("fingerprint", "profile_id", "file_key", "source_offset"),
    "l9_reasons": lambda s, d: _classes(s, d).groupBy(F.substring("session_id", 1, 1).alias("kind"), "disposition").count().withColumnRenamed("count", "n"),
}

_TURNS = """
cv AS (SELECT conv_id AS c, turn AS t, text FROM conversations),
kinds AS (
  SELECT 's' AS kind, c, t, CAST(NULL AS VARCHAR) AS parent, text AS said FROM cv WHERE c % 15 <> 0 OR t <> 1
  UNION ALL SELECT 'f', c, t, 's' || c, CASE WHEN t >= 3 THEN text || '!' ELSE text END FROM cv WHERE c % 3 = 0
  UNION ALL SELECT 'h', c, t, 'f' || c, CASE WHEN t >= 3 THEN text || '!' ELSE text END FROM cv WHERE c % 6 = 0
  UNION ALL SELECT 'c', c, t, CASE WHEN c % 50 <> 0 THEN 'c' || (c - 1) END, 'same' FROM cv WHERE c >= 0
  UNION ALL SELECT 'd', c, t, 's' || c, text FROM cv WHERE c >= 0
  UNION ALL SELECT 'x', c, t, 'y' || c, text FROM cv WHERE c % 40 = 7
  UNION ALL SELECT 'y', c, t, 'x' || c, text FROM cv WHERE c % 40 = 7),
ob AS (SELECT CASE WHEN g % 8 < 4 THEN 'codex' ELSE 'local' END AS provider_id, 'profile_' || g % 4 AS profile_id, kind || CASE WHEN kind = 'd' THEN c // 2 ELSE c END AS session_id,
  parent AS parent_session_id, t AS ordinal, sha256(said) AS signature, t % 5 <> 4 AS strong,
  'file_' || kind AS file_key, 0 AS generation, c * 100 + t AS source_offset, sha256(said || '|' || t) AS fingerprint,
  c % 31 = 0 AND t = 2 AND kind = 's' AS declared_conflict, c % 29 = 0 AND kind = 'f' AS relation_conflict FROM (SELECT *, CASE WHEN kind = 'c' THEN c // 50 ELSE c END AS g FROM kinds)),
rel AS (SELECT provider_id, profile_id, session_id, CASE WHEN count(DISTINCT parent_session_id) = 1 AND min(parent_session_id) <> session_id THEN min(parent_session_id) END AS parent_session_id,
  bool_or(relation_conflict) OR count(DISTINCT parent_session_id) > 1 OR coalesce(min(parent_session_id) = session_id, false) AS relation_conflict FROM ob GROUP BY provider_id, profile_id, session_id),
up AS (
  SELECT provider_id, profile_id, session_id, parent_session_id AS cur, 1 AS depth, CAST([] AS VARCHAR[]) AS seen FROM rel WHERE parent_session_id IS NOT NULL
  UNION ALL
  SELECT up.provider_id, up.profile_id, up.session_id, rel.parent_session_id, up.depth + 1, list_append(up.seen, up.cur)
  FROM up JOIN rel ON rel.provider_id = up.provider_id AND rel.profile_id = up.profile_id AND rel.session_id = up.cur
  WHERE up.cur <> up.session_id AND NOT list_contains(up.seen, up.cur) AND up.depth <= 32 AND NOT rel.relation_conflict AND rel.parent_session_id IS NOT NULL),
far AS (
  SELECT up.*, coalesce(rel.relation_conflict, false) AS bad FROM up LEFT JOIN rel ON rel.provider_id = up.provider_id AND rel.profile_id = up.profile_id AND rel.session_id = up.cur
  QUALIFY row_number() OVER (PARTITION BY up.provider_id, up.profile_id, up.session_id ORDER BY depth DESC) = 1),
anc AS (SELECT provider_id, profile_id, session_id, depth, cur = session_id OR list_contains(seen, cur) AS cycle, depth <= 32 AND bad AND NOT (cur = session_id OR list_contains(seen, cur)) AS conflict,
  depth > 32 AND NOT (cur = session_id OR list_contains(seen, cur)) AS over FROM far),
pf AS (SELECT provider_id, profile_id, session_id AS parent_session_id, ordinal, source_offset, signature, strong, declared_conflict FROM ob
  QUALIFY row_number() OVER (PARTITION BY provider_id, profile_id, session_id, ordinal ORDER BY file_key, generation, source_offset, fingerprint) = 1)"""


def _fold(complete: bool) -> str:
    """The state table, applied row by row: root, matching, diverged, pending, conflict."""
    missing = "'diverged'" if complete else "'pending'"
    return f"""{_TURNS},
wk AS (SELECT ob.*, r.parent_session_id AS up_id, r.relation_conflict OR coalesce(a.cycle OR a.conflict, false) AS barred, coalesce(a.over, false) AS over, p.signature AS psig, p.strong AS pstrong,
  coalesce(p.declared_conflict OR pr.relation_conflict, false) AS pbad, p.parent_session_id IS NULL AS missing,
  row_number() OVER (PARTITION BY provider_id, profile_id, ob.session_id ORDER BY ob.ordinal, ob.file_key, ob.generation, ob.source_offset, ob.fingerprint) AS n
  FROM ob JOIN rel r USING (provider_id, profile_id, session_id) LEFT JOIN anc a USING (provider_id, profile_id, session_id)
  LEFT JOIN pf p ON p.provider_id = ob.provider_id AND p.profile_id = ob.profile_id AND p.parent_session_id = r.parent_session_id AND p.ordinal = ob.ordinal
  LEFT JOIN rel pr ON pr.provider_id = ob.provider_id AND pr.profile_id = ob.profile_id AND pr.session_id = r.parent_session_id),
nx AS (SELECT *, CASE WHEN barred OR declared_conflict OR pbad THEN 'conflict' WHEN over THEN 'over' WHEN up_id IS NULL THEN 'root' WHEN missing THEN {missing}
  WHEN strong AND pstrong AND signature <> psig THEN 'diverged' ELSE 'matching' END AS step FROM wk),
fold AS (
  SELECT *, step AS state FROM nx WHERE n = 1
  UNION ALL
  SELECT nx.*, CASE WHEN f.state = 'conflict' OR nx.step = 'conflict' THEN 'conflict' WHEN f.state IN ('diverged', 'pending') THEN f.state ELSE nx.step END
  FROM fold f JOIN nx ON nx.provider_id = f.provider_id AND nx.profile_id = f.profile_id AND nx.session_id = f.session_id AND nx.n = f.n + 1),
cd AS (SELECT provider_id, profile_id, session_id, ordinal, source_offset, fingerprint, file_key, generation,
  CASE state WHEN 'conflict' THEN 'conflict' WHEN 'over' THEN 'pending' WHEN 'root' THEN 'eligible' WHEN 'diverged' THEN 'eligible' WHEN 'pending' THEN 'pending'
    ELSE CASE WHEN strong AND pstrong THEN 'replay' ELSE 'pending' END END AS disposition FROM fold),
pick AS (SELECT * FROM cd WHERE disposition = 'eligible' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY profile_id, file_key, generation, source_offset) = 1)"""


_PRIOR = """
prior AS (SELECT *, source_offset % 5 <> 0 AS projected FROM (
  SELECT fingerprint, min(source_offset) AS source_offset FROM ob WHERE source_offset % 3 = 0 GROUP BY 1
  UNION ALL SELECT DISTINCT sha256('gone|' || conv_id), conv_id * 100 FROM conversations)),
proven AS (SELECT fingerprint FROM cd GROUP BY 1 HAVING bool_or(disposition = 'replay') AND NOT bool_or(disposition = 'conflict'))"""

SQL = {
    "l1_relations": f"WITH RECURSIVE {_TURNS} SELECT * FROM rel",
    "l2_parent_facts": f"WITH RECURSIVE {_TURNS} SELECT provider_id, profile_id, parent_session_id, ordinal, source_offset, signature, strong FROM pf",
    "l3_ancestors": f"WITH RECURSIVE {_TURNS} SELECT * FROM anc",
    "l4_fan_out": f"WITH RECURSIVE {_TURNS} SELECT provider_id, profile_id, parent_session_id, least(count(*), 257) AS children FROM rel WHERE parent_session_id IS NOT NULL GROUP BY ALL",
    "l5_replay_classes": f"WITH RECURSIVE {_fold(True)} SELECT {', '.join(_OUT)} FROM cd",
    "r5_late_relations": f"WITH RECURSIVE {_fold(True)} SELECT {', '.join(_OUT)} FROM cd",
    "l5_replay_open": f"WITH RECURSIVE {_fold(False)} SELECT {', '.join(_OUT)} FROM cd",
    "l7_materialized": f"WITH RECURSIVE {_fold(True)}, {_PRIOR} SELECT fingerprint, source_offset, 0 AS retained FROM pick UNION ALL SELECT fingerprint, source_offset, 1 FROM prior WHERE projected AND fingerprint NOT IN (SELECT fingerprint FROM pick) AND fingerprint NOT IN (SELECT fingerprint FROM proven)",
    "l9_replay_quality": f"WITH RECURSIVE {_fold(True)} SELECT " + ", ".join(f"count(*) FILTER (disposition = '{d}') AS {d}" for d in ("eligible", "replay", "pending", "conflict")) + " FROM cd",
    "l9_reasons": f"WITH RECURSIVE {_fold(True)} SELECT substr(session_id, 1, 1) AS kind, disposition, count(*) AS n FROM cd GROUP BY 1, 2",
    "c6_selection": f"WITH RECURSIVE {_fold(True)} SELECT fingerprint, profile_id, file_key, source_offset FROM pick",
}
