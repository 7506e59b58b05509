"""JSONL ingest: logs written from `events`, read by the parser, and what must come out, in SQL."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import functions as F

from tallymill.functions.checkpoints import shared_folder, stored
from tallymill.functions.identity import COUNTS, TAG, fingerprint
from tallymill.functions.stretches import STRETCH, along, met
from tallymill.operators import analytics, lineage, rollup
from tallymill.plans import batches
from tallymill.plans.oracle import ZERO
from tallymill.sources import jsonl, log_source, testdata
from tallymill.streaming import parsing

#: Names of the tools that the synthetic logs call.
TOOLS = ("Read_File", "apply_patch", "GREP", "git_log", "run_tests", "http_get", "spawn_agent", "shell", "concatenate")


def logs(spark, sf_dir) -> str:
    """Eight log files of five kinds of lines in the shared folder; returns their root."""
    root = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    raw = testdata.read(spark, sf_dir, "events")
    raw = raw.select("event_id", (F.col("user_id") % 8).alias("f"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.col("value") * 1000).cast("bigint").alias("b"))
    k, b, lit = F.col("k"), F.col("b"), F.lit
    text = lambda head, x: F.concat(lit(head), x.cast("string"))
    part = lambda n: F.floor(b / n).cast("bigint")
    seconds = F.floor(F.col("us") / 1_000_000).cast("bigint")
    obj = lambda **f: F.struct(*[v.alias(n) for n, v in f.items()])
    meta = obj(type=lit("session_meta"), payload=obj(id=text("S", k), cwd=F.concat(lit("/home/u/p"), (k % 4).cast("string"), lit("/")), originator=text("cli", k % 2), forked_from_id=F.when(k % 2 == 0, text("P", F.floor(k / 400))), parent_thread_id=F.when(k % 7 == 0, text("P", k % 3)), git=obj(branch=text("b", k % 3))))
    last = obj(input_tokens=b, cached_input_tokens=F.when(k % 3 == 0, 2 * b).otherwise(part(3)), output_tokens=part(5).cast("string"))
    whole = obj(input_tokens=10 * b, output_tokens=lit(7), reasoning_output_tokens=lit(1))
    count = obj(type=lit("event_msg"), timestamp=F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), lit(".5Z")), payload=obj(type=lit("token_count"), model_slug=F.when(k % 4 == 0, text("model ", k % 3)), info=obj(last_token_usage=last, total_token_usage=whole)))
    running = obj(type=lit("event_msg"), created_at=seconds, payload=obj(type=lit("token_count"), info=obj(total_token_usage=obj(input_tokens=b, output_tokens=part(5), reasoning_output_tokens=k % 7))))
    result = obj(timestamp=lit("never"), response=obj(created_at=F.floor(F.col("us") / 1000).cast("bigint"), model=text("m", k % 3), usage=obj(prompt_tokens=b, completion_tokens=lit("x"), output=k % 9, cached_tokens=lit(1.5), total_tokens=F.when(k % 2 == 0, b).otherwise(0))))
    tool = obj(type=lit("response_item"), payload=obj(type=F.when(k % 3 == 0, lit("mcp_tool")).otherwise(lit("function_call")), name=F.element_at(F.array(*map(lit, TOOLS)), (k % 9 + 1).cast("int"))))
    value = F.when(k % 5 == 0, F.to_json(meta)).when(k % 5 == 1, F.to_json(count)).when(k % 5 == 2, F.to_json(running)).when(k % 5 == 3, F.to_json(result)).otherwise(F.to_json(tool))
    out = raw.select("f", "event_id", value.alias("value"))
    pieces = out.repartitionByRange("f", "event_id").sortWithinPartitions("f", "event_id")
    pieces.select("f", "value").write.partitionBy("f").text(f"{root}/pieces")
    _join_pieces(spark, root)
    out.filter("f < 0").select("value").write.text(f"{root}/archived_sessions")
    return root


def _join_pieces(spark, root: str) -> None:
    """Files of `sessions` from the sorted pieces of each, copied one after another, a block at a time."""
    files, top = log_source.opened(root)
    names = [(i.base_name,) for i in files.get_file_info(fs.FileSelector(f"{top}/pieces")) if not i.is_file]

    def copied(batches):
        files, top = log_source.opened(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                parts = sorted(i.path for i in files.get_file_info(fs.FileSelector(f"{top}/pieces/{name}")) if i.base_name.startswith("part-"))
                begun = f"{top}/sessions/{name}/part-0.txt.{uuid.uuid4().hex}"
                files.create_dir(f"{top}/sessions/{name}", recursive=True)
                with files.open_output_stream(begun) as whole:
                    for part in parts:
                        with files.open_input_stream(part) as piece:
                            while block := piece.read(log_source.BATCH):
                                whole.write(block)
                files.move(begun, f"{top}/sessions/{name}/part-0.txt")
            yield batch

    if names:
        spark.createDataFrame(names, "name string").mapInArrow(copied, "name string").count()
    files.delete_dir(f"{top}/pieces")


def _lines(spark, sf_dir):
    return jsonl.discover(spark, logs(spark, sf_dir), pattern="*.txt")


def _file():
    return F.regexp_extract("relative", r"f=([0-9]+)", 1).cast("bigint").alias("f")


def _said():
    return F.when(F.col("session_id").startswith("part-"), "hint").otherwise(F.col("session_id")).alias("session_id")


_OUT = ("ordinal", "timestamp_seconds", "timestamp_nanos", "parent_session_id", "lineage_conflict", "model", "fallback_model", *COUNTS, "long_context", "project_alias", "originator", "branch", *(f"activity_{a}" for a in jsonl.ACTIVITIES))


def _shown(observed):
    return observed.select(_file(), _said(), *_OUT)


def _canonical(spark, sf_dir):
    got = jsonl.canonical_events(jsonl.observations(_lines(spark, sf_dir)))
    return got.select(_file(), "ordinal", "evidence", "replay_signature")


def _halves(spark, sf_dir):
    """Lines now, and as they were: half of them in even files, all in files 1 and 5, other ones in files 3 and 7."""
    lines = jsonl.in_stretches(stored(_lines(spark, sf_dir).withColumn("f", _file())))
    one = F.lit(1).cast("bigint")
    ranked = along(lines, ("file",), "source_offset", {"n": ("sum", one), "every": ("total", one)})
    before = ranked.filter((F.col("f") % 2 == 1) | (F.col("n") * 2 <= F.col("every"))).withColumn("value", F.when(F.col("f") % 4 == 3, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    lines = lines.drop("f", STRETCH)
    return lines, before.select(*lines.columns)


def _tail(spark, sf_dir):
    now, before = _halves(spark, sf_dir)
    marks = jsonl.prefix_proofs(before).withColumn("generation", F.lit(4))
    fresh, after = jsonl.tail(now, marks)
    n = fresh.groupBy("file", "relative").agg(F.count("*").alias("lines"))
    named = now.select("file", "relative").distinct()
    return named.join(after, "file").join(n, ["file", "relative"], "left").select(_file(), F.coalesce("lines", F.lit(0)).alias("lines"), "generation")


def _resumed(spark, sf_dir):
    """Files that grew go on from their state, rewritten ones start anew, the others say nothing."""
    now, before = _halves(spark, sf_dir)
    before = stored(before)
    fresh = stored(jsonl.tail(now, jsonl.prefix_proofs(before).withColumn("generation", F.lit(0)))[0])
    grown = fresh.filter("generation = 0").select("file").distinct()
    state = jsonl.state_after(met(before, grown, ("file",), "source_offset", "left_semi").select(*before.columns))
    return _shown(jsonl.observations(fresh.drop("generation"), state))


def _full_run(spark, sf_dir):
    """Logs to lifetime totals: lines, observations, events that count, one of each identity, the time rollup."""
    seen = jsonl.canonical_events(jsonl.observations(_lines(spark, sf_dir))).withColumns({"provider_id": F.lit("codex"), "profile_id": F.concat(F.lit("profile_"), _file()), "session_id": _said()})
    events = seen.withColumns({"fingerprint": fingerprint("ordinal"), "file_key": F.col("relative"), "generation": F.lit(0)}).drop("cumulative")
    return analytics.lifetime(rollup.time_rollup(lineage.canonical(events)))


def _tools(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    tool = jsonl.tool_call(jsonl.parsed(F.col("value")))
    return lines.select(tool.alias("tool"), jsonl.tool_activity(tool).alias("activity")).filter("tool IS NOT NULL").groupBy("tool", "activity").agg(F.count("*").alias("n"))


def _parsed_stream(spark, sf_dir):
    """The lines as a stream in three batches, a part of every file in each."""
    lines = stored(_lines(spark, sf_dir).withColumn("generation", F.lit(0)))
    cut = lines.agg(F.max("source_offset")).first()[0] or 0
    thirds = [lines.filter(F.col("source_offset").between(cut * k // 3 + (k > 0), cut * (k + 1) // 3)) for k in range(3)]
    store = parsing.ObservationStore(spark, f"{shared_folder(spark)}/observed-{uuid.uuid4().hex}")
    batches.applied(spark, thirds, store.apply, rows=100_000)
    return _shown(store.observations())


QUERIES = {
    "r4_streamed_observations": _parsed_stream,
    "s3_lines": lambda s, d: _lines(s, d).groupBy(_file()).agg(F.count("*").alias("lines"), F.min("source_offset").alias("at")),
    "s4_tail": _tail,
    "s6_observations": lambda s, d: _shown(jsonl.observations(_lines(s, d))),
    "s15_tools": _tools,
    "c1_canonical_events": _canonical,
    "r1_full_run": _full_run,
    "r4_resumed_observations": _resumed,
}

_E = """
e AS (SELECT event_id, user_id % 8 AS f, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 1000) AS BIGINT) AS b FROM events),
l AS (SELECT *, k % 5 AS kind, CASE WHEN k % 5 = 4 THEN CASE k % 9 """ + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(("read", "edit_write", "search", "git", "build_test", "web", "subagents", "terminal", "read"))) + """ END END AS act,
  row_number() OVER (PARTITION BY f ORDER BY event_id) AS n, count(*) OVER (PARTITION BY f) AS every FROM e),
u AS (SELECT *,
  CASE kind WHEN 1 THEN 10 * b WHEN 2 THEN b END AS ci, CASE kind WHEN 1 THEN 7 WHEN 2 THEN CAST(floor(b / 5) AS BIGINT) END AS co, CASE kind WHEN 1 THEN 1 WHEN 2 THEN k % 7 END AS cr,
  CASE WHEN kind = 0 AND k % 2 = 0 THEN 'P' || CAST(floor(k / 400) AS BIGINT) END AS p1, CASE WHEN kind = 0 AND k % 7 = 0 THEN 'P' || k % 3 END AS p2 FROM l),
w AS (SELECT *, ci + co + cr AS ct, coalesce(p1, p2) AS lp, coalesce(p1 <> p2, false) AS lc,
  lag(ci IGNORE NULLS) OVER o AS pi, lag(co IGNORE NULLS) OVER o AS po, lag(cr IGNORE NULLS) OVER o AS pr FROM u WINDOW o AS (PARTITION BY f ORDER BY event_id)),
x AS (SELECT *, pi + po + pr AS pt,
  CASE WHEN kind = 1 THEN b WHEN kind = 3 THEN b WHEN kind = 2 THEN CASE WHEN pi IS NULL OR ci < pi THEN ci ELSE ci - pi END END AS input_tokens,
  CASE WHEN kind = 1 THEN CASE WHEN k % 3 = 0 THEN b ELSE least(CAST(floor(b / 3) AS BIGINT), b) END END AS cached_tokens,
  CASE WHEN kind = 1 THEN CAST(floor(b / 5) AS BIGINT) WHEN kind = 3 THEN k % 9 WHEN kind = 2 THEN CASE WHEN po IS NULL OR co < po THEN co ELSE co - po END END AS output_tokens,
  CASE WHEN kind = 2 THEN CASE WHEN pr IS NULL OR cr < pr THEN cr ELSE cr - pr END END AS reasoning_tokens FROM w),
y AS (SELECT *, CASE WHEN kind = 3 AND k % 2 = 0 AND b > 0 THEN b WHEN kind = 2 THEN CASE WHEN pt IS NULL OR ct < pt THEN ct ELSE ct - pt END END AS total_tokens FROM x),
z AS (SELECT *, kind IN (1, 2, 3) AND greatest(coalesce(input_tokens, 0), coalesce(cached_tokens, 0), coalesce(output_tokens, 0), coalesce(reasoning_tokens, 0), coalesce(total_tokens, 0)) > 0 AS emits,
  CASE WHEN kind = 1 AND k % 4 = 0 THEN 'unknown_' || substr(sha256('model ' || k % 3), 1, 32) END AS slug FROM y),
m AS (SELECT *, CASE WHEN kind = 3 AND emits THEN 'm' || k % 3 ELSE slug END AS lm FROM z),
c AS (SELECT *, coalesce(last_value(lm IGNORE NULLS) OVER o, 'unknown') AS model, last_value(lm IGNORE NULLS) OVER o IS NULL AS fb,
  coalesce(last_value(CASE WHEN kind = 0 THEN 'S' || k END IGNORE NULLS) OVER o, 'hint') AS session_id, last_value(CASE WHEN kind = 0 THEN 'p' || k % 4 END IGNORE NULLS) OVER o AS project_alias,
  last_value(CASE WHEN kind = 0 THEN 'cli' || k % 2 END IGNORE NULLS) OVER o AS originator, last_value(CASE WHEN kind = 0 THEN 'b' || k % 3 END IGNORE NULLS) OVER o AS branch,
  first_value(lp IGNORE NULLS) OVER o AS fp, coalesce(sum(CAST(emits AS INT)) OVER (PARTITION BY f ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS batch
  FROM m WINDOW o AS (PARTITION BY f ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, bool_or(lc OR coalesce(lp <> fp, false)) OVER (PARTITION BY f ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lineage_conflict,
  """ + ", ".join(f"count(*) FILTER (act = '{a}') OVER (PARTITION BY f, batch) AS activity_{a}" for a in jsonl.ACTIVITIES) + """ FROM c),
ob AS (SELECT f, n, every, session_id, CAST(batch AS BIGINT) AS ordinal, CASE kind WHEN 3 THEN us // 1000000 ELSE sec END AS timestamp_seconds,
  CAST(CASE kind WHEN 1 THEN 500000000 WHEN 3 THEN (us // 1000) % 1000 * 1000000 ELSE 0 END AS BIGINT) AS timestamp_nanos, coalesce(lp, fp) AS parent_session_id, lineage_conflict, model, CAST(fb AS BIGINT) AS fallback_model,
  input_tokens, cached_tokens, output_tokens, reasoning_tokens, total_tokens, CASE WHEN input_tokens > 272000 THEN 'yes' ELSE 'no' END AS long_context, project_alias, originator, branch,
  """ + ", ".join(f"activity_{a}" for a in jsonl.ACTIVITIES) + """, kind, ci, co, cr, ct FROM g WHERE emits)"""

_COLUMNS = ", ".join(("f", "session_id", *_OUT))


def _signature() -> str:
    count = lambda c: f"CASE WHEN {c} IS NULL THEN unhex('00') ELSE unhex('01') || unhex(printf('%016x', {c})) END"
    whole = " || ".join(count(c) for c in ("ci", "CAST(NULL AS BIGINT)", "co", "cr", "ct"))
    return f"sha256(encode('{TAG}.replay') || unhex(printf('%08x', strlen(model))) || encode(model) || {' || '.join(map(count, COUNTS))} || CASE WHEN kind = 3 THEN unhex('00') ELSE unhex('01') || {whole} END)"


_T = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOOLS))
SQL = {
    "s3_lines": f"WITH {_E} SELECT f, count(*) AS lines, CAST(0 AS BIGINT) AS at FROM l GROUP BY f",
    "s4_tail": f"WITH {_E} SELECT f, CAST(CASE f % 4 WHEN 1 THEN 0 WHEN 3 THEN max(every) ELSE max(every) - max(every) // 2 END AS BIGINT) AS lines, CASE f % 4 WHEN 3 THEN 5 ELSE 4 END AS generation FROM l GROUP BY f",
    "s6_observations": f"WITH {_E} SELECT {_COLUMNS} FROM ob",
    "r4_streamed_observations": f"WITH {_E} SELECT {_COLUMNS} FROM ob",
    "s15_tools": f"WITH {_E} SELECT CASE k % 9 {_T} END AS tool, act AS activity, count(*) AS n FROM l WHERE kind = 4 GROUP BY 1, 2",
    "c1_canonical_events": f"WITH {_E} SELECT f, ordinal, CASE WHEN kind = 3 THEN 'weak' ELSE 'strong' END AS evidence, {_signature()} AS replay_signature FROM ob WHERE kind = 3 OR (ci >= input_tokens AND co >= output_tokens AND coalesce(cr >= reasoning_tokens, true) AND coalesce(ct >= total_tokens, true))",
    "r1_full_run": f"WITH {_E} SELECT {ZERO} FROM ob WHERE kind = 3 OR (ci >= input_tokens AND co >= output_tokens AND coalesce(cr >= reasoning_tokens, true) AND coalesce(ct >= total_tokens, true))",
    "r4_resumed_observations": f"WITH {_E} SELECT {_COLUMNS} FROM ob WHERE f % 2 = 0 AND n * 2 > every OR f % 4 = 3",
}
