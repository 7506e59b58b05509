"""Git output and product status: registered queries and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import git_output, status
from tallymill.sources import testdata

FIRST, LAST = 9000, 9400
AUTHORS = ["dev1@x", "dev3@x"]
SALT = "salt"


def _log(spark, sf_dir, short=True):
    """The changes of all logs, one text of repository 3 being cut short."""
    logs = testdata.git_log(spark, sf_dir)
    cut = F.lit(short) & (F.col("repository_id") == 3) & (F.col("part") == 0)
    return git_output.parse_log(logs.withColumn("log", F.when(cut, F.expr("substr(log, 1, length(log) - 3)")).otherwise(F.col("log"))), AUTHORS)


def _days(spark, sf_dir):
    return git_output.days(testdata.git_changes(spark, sf_dir))


def _captures(spark, sf_dir):
    linked = git_output.associations(testdata.git_associations(spark, sf_dir))
    return git_output.captures(testdata.git_repositories(spark, sf_dir), _days(spark, sf_dir), linked, FIRST)


def _kinds(spark, sf_dir):
    before, now = testdata.git_refs(spark, sf_dir, False), testdata.git_refs(spark, sf_dir, True)
    old = before.select(F.col("object_id").alias("old_id"))
    reaches = old.select("old_id", F.regexp_replace("old_id", "1$", "2").alias("new_id")).filter("CAST(regexp_extract(old_id, '-([0-9]+)-', 1) AS BIGINT) % 20 <> 3")
    return git_output.refresh_kinds(before.drop("shallow"), now, reaches)


def _published(spark, sf_dir):
    changes = testdata.git_changes(spark, sf_dir)
    parts = [git_output.day_categories(changes.filter(F.col("commit_id") % 3 == 0) if k else changes.filter(F.col("commit_id") % 3 != 0)) for k in (0, 1)]
    kinds = spark.createDataFrame([(0, "append"), (1, "append"), (2, "rebuild"), (3, "unchanged"), (4, "append")], "repository_id long, refresh string")
    return git_output.published(parts[0], parts[1], kinds)


def _matches(spark, sf_dir):
    keys = testdata.git_associations(spark, sf_dir).select("project_key").filter("project_key IS NOT NULL").distinct()
    projects = spark.createDataFrame([("proj_0",), ("proj_1",), ("proj_9",)], "project string")
    return git_output.project_matches(keys, projects, SALT)


def _product_lines(spark, sf_dir):
    return git_output.range_categories(git_output.day_categories(testdata.git_changes(spark, sf_dir)), FIRST, LAST).filter("category = 'product_code'").select("repository_id", F.col("added").alias("product_lines"))


def _judged(spark, sf_dir):
    """Each repository with its project's cost: a sum over the project's events, known for all but proj_2, in conflict for none."""
    projects = spark.createDataFrame([("proj_0",), ("proj_1",), ("proj_2",)], "project string").withColumn("project_key", git_output.project_key(SALT, F.col("project")))
    e = testdata.usage_event(spark, sf_dir).filter("project_alias <> 'proj_2'").groupBy(F.col("project_alias").alias("project")).agg(F.sum("reported_cost_usd_micros").cast("bigint").alias("amount"))
    cost = e.select("project", F.struct("amount", F.lit("complete").alias("availability"), F.lit(0).cast("bigint").alias("conflict_events")).alias("cost"))
    rows = _captures(spark, sf_dir).join(projects, "project_key", "left").join(cost, "project", "left").join(_product_lines(spark, sf_dir), "repository_id", "left").fillna(0, ["product_lines"])
    rows = rows.withColumns({"forced_reason": F.when(F.col("repository_id") == 9, "range_mismatch"), "usage_quality_complete": F.lit(True), "usage_freshness": F.lit("aging")})
    return rows.withColumn("reason", git_output.unavailable_reason(F.col("product_lines")))


def _efficiency(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    return rows.select("repository_id", "reason", F.when(F.col("reason").isNull(), git_output.efficiency(F.col("cost.amount"), F.col("product_lines"))).alias("per_100_lines"))


def _project_code(spark, sf_dir):
    totals = git_output.range_totals(_days(spark, sf_dir), FIRST, LAST)
    rows = _judged(spark, sf_dir).select("repository_id", F.coalesce("project", F.lit("")).alias("project"), "range_complete", "quality", "reason", F.col("cost.amount").alias("cost"), F.lit(1).alias("dataset"), "product_lines")
    return git_output.project_code(rows.join(totals, "repository_id")).filter("project <> ''")


def _scan_sets(spark, sf_dir):
    e = testdata.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 50).alias("scan_set_id"), F.col("event_type"))
    scans = e.select("scan_set_id", F.when((F.col("event_type") == "error") & (F.col("scan_set_id") % 3 == 0), "failed").otherwise("complete").alias("completion_state"))
    sets = e.groupBy("scan_set_id").agg((F.count("*") + F.when(F.col("scan_set_id") % 7 == 0, 1).otherwise(0)).alias("expected_scopes")).select("scan_set_id", "expected_scopes", F.when(F.col("scan_set_id") % 11 == 0, "running").otherwise("complete").alias("completion_state"), F.when(F.col("scan_set_id") % 11 != 0, F.col("scan_set_id") * 1000 + 1).alias("completed_at_ms"))
    return sets, scans


def _revisions(spark, sf_dir):
    e = testdata.read(spark, sf_dir, "events").select((F.col("event_id") % 20).alias("revision_id"), F.when(F.col("event_type") == "click", "complete").otherwise("waiting").alias("state"))
    revisions = e.groupBy("revision_id").agg((F.count("*") + F.when(F.col("revision_id") == 4, 2).otherwise(0)).alias("expected_sources")).withColumn("quality", F.when(F.col("revision_id") % 2 == 0, "partial").otherwise("complete"))
    return revisions, e


def _quality(spark, sf_dir):
    e = testdata.read(spark, sf_dir, "events").select("event_id")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(F.col("event_id") / n) % len(v) + 1).cast("int"))
    rows = e.select("event_id", pick(1, "empty", "current", "legacy_snapshot").alias("i"), pick(3, "empty", "complete", "partial", "recovery_pending").alias("q"), (pick(12, 0, 1) == 1).alias("v"))
    got = rows.withColumn("s", status.dataset_quality(F.col("i"), F.col("q"), F.col("v")))
    return got.select("event_id", "s.quality", F.array_join("s.warnings", ",").alias("warnings"))


def _status(spark, sf_dir):
    sets, scans = _scan_sets(spark, sf_dir)
    revisions, sources = _revisions(spark, sf_dir)
    samples = testdata.quota_samples(spark, sf_dir)
    got = status.product_status(
        scan=status.scan_truth(sets, scans).filter("scan_set_id = 1"), progress=status.import_progress(revisions, sources).filter("revision_id = 2"), quota=samples.agg(F.count("*").alias("samples"), F.max("observed_at_ms").alias("through_ms")),
        git=testdata.git_repositories(spark, sf_dir).agg(F.count("*").alias("repositories")), none=samples.filter("observed_at_ms < 0"),
    )
    return got.select("scan.completed_at_ms", "scan.scopes", "scan.sound", "progress.complete_sources", "progress.expected_sources", "quota.samples", "quota.through_ms", "git.repositories", F.col("none").isNull().alias("nothing"))


def _manifests(spark, sf_dir):
    e = testdata.usage_event(spark, sf_dir).select("provider_id", "profile_id", "session_id").distinct()
    bucket = F.regexp_extract("session_id", "([0-9]+)$", 1).cast("bigint") % 10
    return status.manifest_difference(e.filter(bucket != 1), e.filter(bucket != 2))


def _integrity(spark, sf_dir):
    samples, lots = testdata.quota_samples(spark, sf_dir), testdata.benefit_lots(spark, sf_dir, False)
    told = lambda d, n: d.agg((F.count("*") + n).alias("told"))
    return status.integrity({"quota_samples": (told(samples, 0), samples), "benefit_lots": (told(lots, 1), lots)})


QUERIES = {
    "s21_log_changes": _log,
    "s21_sound_changes": lambda s, d: git_output.sound(_log(s, d)),
    "s22_refresh_kinds": _kinds,
    "g2_commits": lambda s, d: git_output.commits(_log(s, d, False).filter("selected")),
    "g4_range_totals": lambda s, d: git_output.range_totals(_days(s, d), FIRST, LAST),
    "g6_associations": lambda s, d: git_output.associations(testdata.git_associations(s, d)),
    "g7_range_completeness": lambda s, d: _captures(s, d).select("repository_id", "range_complete", "quality", "retained_from"),
    "g8_repository_page": lambda s, d: git_output.repository_page(testdata.git_repositories(s, d), 3, 0).select("repository_id", "has_more"),
    "g9_project_matches": _matches,
    "g10_efficiency_reasons": _efficiency,
    "g12_published": _published,
    "x5_project_code": _project_code,
    "t3_quality": _quality,
    "t5_product_status": _status,
    "t6_import_progress": lambda s, d: status.import_progress(*_revisions(s, d)),
    "t7_scan_truth": lambda s, d: status.scan_truth(*_scan_sets(s, d)),
    "t8_manifest_difference": _manifests,
    "t10_integrity": _integrity,
}

_PATHS = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(testdata.PATHS))
_LOG = f"""
li AS (SELECT *, CAST(l_orderkey AS BIGINT) AS k, l_partkey % {len(testdata.PATHS)} AS n FROM lineitem),
wh AS (SELECT k, CAST(min(CAST(floor(epoch(l_shipdate)) AS BIGINT)) AS BIGINT) AS t FROM li GROUP BY k),
lg AS (SELECT li.k % 5 AS repository_id, sha256(CAST(li.k AS VARCHAR)) AS "commit", CAST(floor(t / 86400) AS BIGINT) AS day_index, CASE WHEN li.k % 17 = 0 THEN 2 WHEN li.k % 100 = 1 THEN 0 ELSE 1 END AS parents,
  li.k % 3 = 1 OR li.k % 4 IN (1, 3) AS selected, CASE n {_PATHS} END || CASE WHEN l_linenumber = 4 THEN chr(9) || '7' || chr(9) || 'x' || chr(30) || ':y' ELSE '' END AS path, CASE WHEN n = 7 THEN 'submodule' WHEN n = 5 THEN 'binary' ELSE 'text' END AS kind,
  CASE WHEN n NOT IN (5, 7) THEN CAST(l_quantity AS BIGINT) END AS added, CASE WHEN n NOT IN (5, 7) THEN CAST(floor(l_quantity / 2) AS BIGINT) END AS removed FROM li JOIN wh ON wh.k = li.k WHERE li.k % 17 <> 0
  UNION ALL SELECT k % 5, sha256(CAST(k AS VARCHAR)), CAST(floor(t / 86400) AS BIGINT), 2, k % 3 = 1 OR k % 4 IN (1, 3), NULL, NULL, NULL, NULL FROM wh WHERE k % 17 = 0),
cut AS (SELECT sha256(CAST(k AS VARCHAR)) AS c FROM wh WHERE k % 5 = 3 AND k < 1000)"""
_DAYS = """
ch AS (SELECT CAST(l_suppkey % 5 AS BIGINT) AS repository_id, CAST(l_orderkey AS BIGINT) AS commit_id, l_partkey % 10 AS n, CAST(l_quantity AS BIGINT) AS a, CAST(floor(l_quantity / 2) AS BIGINT) AS r, l_orderkey % 17 = 0 AS m, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS day_index FROM lineitem),
cm AS (SELECT repository_id, day_index, commit_id, bool_or(m) AS m, sum(a) AS a, sum(r) AS r FROM ch GROUP BY ALL),
dy AS (SELECT repository_id, day_index, count(*) AS commits, count(*) FILTER (m) AS merge_commits, coalesce(sum(a) FILTER (NOT m), 0) AS added, coalesce(sum(r) FILTER (NOT m), 0) AS removed FROM cm GROUP BY repository_id, day_index
  QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY day_index DESC) <= 400)"""
_TOTALS = f"""tt AS (SELECT repository_id, """ + ", ".join(f"CAST(coalesce(sum({c}) FILTER (day_index BETWEEN {FIRST} AND {LAST}), 0) AS BIGINT) AS {c}" for c in ("commits", "merge_commits", "added", "removed")) + " FROM dy GROUP BY 1)"
_ASSOC = f"""
ga AS (SELECT printf('a%05d', s_suppkey) AS association_id, CAST(s_suppkey % 5 AS BIGINT) AS repository_id, CASE WHEN s_suppkey % 5 <> 4 OR s_suppkey % 2 = 0 THEN sha256('tallymill.project.{SALT}|proj_' || (s_suppkey % 5) % 3) END AS project_key, s_suppkey % 7 * 1000 AS seen FROM supplier),
lk AS (SELECT repository_id, first(association_id ORDER BY seen DESC, association_id) AS association_id, CASE WHEN count(*) = count(project_key) AND count(DISTINCT project_key) = 1 THEN min(project_key) END AS project_key, count(*) = count(project_key) AND count(DISTINCT project_key) = 1 AS associated FROM ga GROUP BY 1)"""
_CAPTURES = f"""{_DAYS}, {_ASSOC},
rp AS (SELECT DISTINCT CAST(s_suppkey % 5 AS BIGINT) AS repository_id FROM supplier),
cp AS (SELECT rp.repository_id, min_day AS retained_from, rp.repository_id <> 2 OR coalesce({FIRST} >= min_day, false) AS range_complete, CASE WHEN rp.repository_id = 4 OR NOT coalesce(associated, false) OR rp.repository_id = 3 THEN 'partial' ELSE 'complete' END AS quality, project_key
  FROM rp LEFT JOIN (SELECT repository_id, min(day_index) AS min_day FROM dy GROUP BY 1) f ON f.repository_id = rp.repository_id LEFT JOIN lk ON lk.repository_id = rp.repository_id)"""
#: Paths of the synthetic commits that are product code: the first and the last of them, by number.
_PRODUCT = "n IN (0, 6, 9)"
_JUDGED = f"""{_CAPTURES}, {_TOTALS},
co AS (SELECT 'proj_' || k % 7 AS project, CAST(sum(CASE WHEN k % 5 = 0 THEN b * 7 END) AS BIGINT) AS amount FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 1000) AS BIGINT) AS b FROM events) WHERE k % 10 <> 0 AND k % 7 <> 2 GROUP BY 1),
pj AS (SELECT p AS project, sha256('tallymill.project.{SALT}|' || p) AS project_key FROM (VALUES ('proj_0'), ('proj_1'), ('proj_2')) v(p)),
pl AS (SELECT repository_id, CAST(sum(a) AS BIGINT) AS lines FROM ch WHERE NOT m AND {_PRODUCT} AND day_index BETWEEN {FIRST} AND {LAST} GROUP BY 1),
jd AS (SELECT cp.repository_id, pj.project, range_complete, quality, amount, coalesce(lines, 0) AS lines, CASE WHEN NOT range_complete THEN 'git_range_incomplete' WHEN quality <> 'complete' THEN 'git_quality_incomplete' WHEN cp.project_key IS NULL THEN 'association_unavailable'
  WHEN coalesce(lines, 0) = 0 THEN 'zero_product_code_lines' WHEN cp.repository_id = 1 THEN 'git_stale' WHEN amount IS NULL THEN 'project_not_in_usage_snapshot' END AS reason
  FROM cp LEFT JOIN pj ON pj.project_key = cp.project_key LEFT JOIN co ON co.project = pj.project LEFT JOIN pl ON pl.repository_id = cp.repository_id)"""
_PER = "CAST(floor((CAST({c} AS DECIMAL(30, 0)) * 100 + {n} // 2) // {n}) AS BIGINT)"
_CATEGORY = "CASE n WHEN 0 THEN 'product_code' WHEN 1 THEN 'test' WHEN 2 THEN 'docs_spec' WHEN 3 THEN 'vendor_generated' WHEN 4 THEN 'schema_migration' WHEN 5 THEN 'asset' WHEN 6 THEN 'product_code' WHEN 7 THEN 'other' WHEN 8 THEN 'vendor_generated' ELSE 'product_code' END"
_EV = "ev AS (SELECT event_id, event_type FROM events)"
_SCAN = f"""{_EV}, ss AS (SELECT event_id % 50 AS id, count(*) AS n, count(*) FILTER (NOT (event_type = 'error' AND event_id % 50 % 3 = 0)) AS done FROM ev GROUP BY 1),
sr AS (SELECT id AS scan_set_id, CASE WHEN id % 11 <> 0 THEN id * 1000 + 1 END AS completed_at_ms, n AS scopes, id % 11 <> 0 AND id % 7 <> 0 AND done = n AS sound FROM ss)"""
_PROGRESS = "ip AS (SELECT event_id % 20 AS revision_id, CASE WHEN event_id % 20 <> 4 THEN count(*) FILTER (event_type = 'click') END AS complete_sources, CASE WHEN event_id % 20 <> 4 THEN count(*) END AS expected_sources FROM ev WHERE event_id % 20 % 2 = 0 GROUP BY event_id % 20)"
SQL = {
    "s21_log_changes": f"""WITH {_LOG} SELECT *, CAST(NULL AS VARCHAR) AS error FROM lg WHERE "commit" NOT IN (SELECT c FROM cut) UNION ALL SELECT 3, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'incomplete'""",
    "s21_sound_changes": f"WITH {_LOG} SELECT * FROM lg WHERE repository_id <> 3",
    "s22_refresh_kinds": """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey // 10 AS BIGINT) AS r FROM part),
x AS (SELECT r, k, NOT (r % 8 = 0 AND k % 10 = 9) AS was, NOT (r % 16 = 3 AND k % 10 = 4) AS still, r % 4 = 1 AND k % 2 = 0 OR r % 4 = 2 AS moved FROM p)
SELECT r AS repository_id, CASE WHEN count(*) FILTER (was) = 0 THEN 'rebuild' WHEN bool_and(was AND still AND NOT moved) THEN 'unchanged' WHEN bool_and(NOT was OR (still AND (NOT moved OR k % 20 <> 3))) AND NOT bool_or(r % 8 = 5) THEN 'append' ELSE 'rebuild' END AS refresh FROM x WHERE was OR still GROUP BY r""",
    "g2_commits": f"""WITH {_LOG} SELECT repository_id, "commit", day_index, parents, CAST(coalesce(sum(added) FILTER (parents < 2), 0) AS BIGINT) AS added, CAST(coalesce(sum(removed) FILTER (parents < 2), 0) AS BIGINT) AS removed,
  count(*) FILTER (kind = 'binary') AS binary_files, count(*) FILTER (kind = 'submodule') AS submodule_changes, count(path) AS changed_paths FROM lg WHERE selected GROUP BY ALL""",
    "g4_range_totals": f"WITH {_DAYS}, {_TOTALS} SELECT * FROM tt",
    "g6_associations": f"WITH {_ASSOC} SELECT * FROM lk",
    "g7_range_completeness": f"WITH {_CAPTURES} SELECT repository_id, range_complete, quality, retained_from FROM cp",
    "g8_repository_page": "SELECT repository_id, (SELECT count(DISTINCT s_suppkey % 5) > 4 FROM supplier) AS has_more FROM (SELECT DISTINCT CAST(s_suppkey % 5 AS BIGINT) AS repository_id FROM supplier) WHERE repository_id > 0 ORDER BY 1 LIMIT 3",
    "g9_project_matches": f"WITH {_ASSOC} SELECT DISTINCT ga.project_key, p.project FROM ga LEFT JOIN (VALUES ('proj_0'), ('proj_1'), ('proj_9')) p(project) ON sha256('tallymill.project.{SALT}|' || p.project) = ga.project_key WHERE ga.project_key IS NOT NULL",
    "g10_efficiency_reasons": f"WITH {_JUDGED} SELECT repository_id, reason, CASE WHEN reason IS NULL THEN {_PER.format(c='amount', n='lines')} END AS per_100_lines FROM jd",
    "g12_published": f"""WITH {_DAYS}, dc AS (SELECT repository_id, day_index, {_CATEGORY} AS category, a, r, commit_id % 3 = 0 AS late FROM ch WHERE NOT m)
SELECT repository_id, day_index, category, CAST(sum(a) AS BIGINT) AS added, CAST(sum(r) AS BIGINT) AS removed FROM dc WHERE CASE repository_id WHEN 2 THEN late WHEN 3 THEN NOT late ELSE true END GROUP BY ALL""",
    "x5_project_code": f"""WITH {_JUDGED}, q AS (SELECT jd.*, tt.commits, tt.added, tt.removed FROM jd JOIN tt ON tt.repository_id = jd.repository_id WHERE project IS NOT NULL),
z AS (SELECT project, count(*) AS repositories, CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, bool_and(range_complete AND quality = 'complete') AS complete, first(reason ORDER BY repository_id) FILTER (reason IS NOT NULL) AS said, min(amount) AS cost, CAST(sum(lines) AS BIGINT) AS n FROM q GROUP BY 1)
SELECT project, repositories, commits, added, removed, added - removed AS net, complete, CASE WHEN said IS NULL AND cost IS NOT NULL AND n > 0 THEN {_PER.format(c='cost', n='n')} END AS efficiency, CASE WHEN said IS NOT NULL THEN said WHEN cost IS NULL OR n = 0 THEN 'zero_product_code_lines' END AS reason FROM z""",
    "t3_quality": """WITH t AS (SELECT event_id, ['empty', 'current', 'legacy_snapshot'][event_id % 3 + 1] AS i, ['empty', 'complete', 'partial', 'recovery_pending'][(event_id // 3) % 4 + 1] AS q, (event_id // 12) % 2 = 1 AS v FROM events),
m AS (SELECT *, CASE WHEN q = 'empty' THEN CASE WHEN i = 'empty' THEN 'authoritative' END WHEN q = 'complete' THEN 'authoritative' ELSE 'partial' END AS g FROM t)
SELECT event_id, CASE WHEN i = 'legacy_snapshot' OR (g IS NOT NULL AND NOT v) THEN 'unknown' ELSE g END AS quality,
  CASE WHEN i = 'legacy_snapshot' THEN 'legacy_unverified' ELSE concat_ws(',', CASE WHEN q IN ('partial', 'recovery_pending') THEN q END, CASE WHEN g IS NOT NULL AND NOT v THEN 'accounting_version_stale' END) END AS warnings FROM m""",
    "t5_product_status": f"""WITH {_SCAN}, {_PROGRESS} SELECT completed_at_ms, scopes, sound, complete_sources, expected_sources, (SELECT count(*) FROM events) AS samples, (SELECT max(epoch_us(ts) // 1000) FROM events) AS through_ms,
  (SELECT count(DISTINCT s_suppkey % 5) FROM supplier) AS repositories, true AS nothing FROM sr, ip WHERE scan_set_id = 1 AND revision_id = 2""",
    "t6_import_progress": f"WITH {_EV}, {_PROGRESS} SELECT * FROM ip",
    "t7_scan_truth": f"WITH {_SCAN} SELECT * FROM sr",
    "t8_manifest_difference": """WITH m AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'local' ELSE 'codex' END AS provider_id, 'profile_' || user_id % 4 AS profile_id, 'session_' || user_id AS session_id, user_id % 10 AS b FROM events)
SELECT provider_id, profile_id, session_id, CASE b WHEN 2 THEN 'expected' ELSE 'found' END AS side FROM m WHERE b IN (1, 2)""",
    "t10_integrity": "SELECT 'quota_samples' AS \"check\", count(*) AS told, count(*) AS counted, true AS sound FROM events UNION ALL SELECT 'benefit_lots', count(*) + 1, count(*), false FROM orders WHERE o_orderkey % 4 <> 1",
}
