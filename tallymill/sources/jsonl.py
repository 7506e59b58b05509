"""JSONL agent logs to usage observations: discovery, line filter, lenient fields, carried state, deltas, activities.

Lines become narrow facts; what a file says is carried along it, stretch by stretch, so no task holds a file. A file's
state at a place (`state_after`) is a row of facts again, so a grown file is read on from there (`tail`), with the same
result as reading it whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.functions.checkpoints import stored
from tallymill.functions.identity import replay_signature
from tallymill.functions.stretches import STRETCH, along, met
from tallymill.sources import log_source

LONG, ID_BYTES = 272_000, 512
#: Bytes of a file that are one stretch of it.
STRETCH_BYTES = 4 << 20
#: What a relevant line contains (or a backslash).
MARKERS = ("token_count", "turn_context", "session_meta", "sessionMeta", '"usage"', "function_call", "tool_call", "exec_command", "mcp")
#: Names of the counters, in order of precedence.
ALIASES = {
    "input": ("input_tokens", "prompt_tokens", "input"),
    "cached": ("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"),
    "output": ("output_tokens", "completion_tokens", "output"),
    "reasoning": ("reasoning_output_tokens", "reasoning_tokens"),
    "total": ("total_tokens",),
}
COUNTS = tuple(ALIASES)
#: Where a model stands in a count line, in metadata, and in a result; and where a parent stands.
COUNT_MODELS = ("payload.model", "payload.model_name", "payload.model_slug", "payload.model_id", "payload.info.model", "payload.info.model_name", "payload.requested_model", "payload.default_model")
META_MODELS = ("payload.model", "payload.model_name", "payload.model_slug", "payload.model_id", "payload.requested_model", "payload.default_model")
PARENTS = ("forked_from_id", "parent_thread_id", "payload.forked_from_id", "payload.parent_thread_id", "payload.source.subagent.thread_spawn.parent_thread_id")
TIMES = ("timestamp", "created_at", "createdAt")
#: Kinds of a tool call, parts of a tool's name and its activity, tried in this order.
TOOL_KINDS = ("function_call", "tool_call", "exec_command", "mcp")
TOOLS = (
    ("read", ("read", "cat", "view")),
    ("edit_write", ("write", "edit", "patch", "create")),
    ("search", ("search", "grep", "find")),
    ("git", ("git",)),
    ("build_test", ("test", "build", "compile")),
    ("web", ("web", "browser", "http")),
    ("subagents", ("agent", "delegate", "spawn")),
)
ACTIVITIES = (*(t for t, _ in TOOLS), "terminal")
WRAPPERS = ("data", "result", "response")
#: What a file carries along, by the name of the fact on a line.
CARRIED = {"line_session": "session_id", "line_project": "project_alias", "line_originator": "originator", "line_branch": "branch", "line_tier": "service_tier", "line_source": "source_alias", "line_window": "context_window", "line_model": "model"}


def discover(spark: SparkSession, root: str, paths: list[str] | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """(file, relative, place, source_offset, value) of all whole lines below sessions and archived_sessions.

    `source_offset` is the line's first byte. A line end takes one carriage return with it; a last line without an end
    is not taken yet; lines over 16 MiB are left out. An archived file with an active namesake is left out. `paths`
    (relative) limits listing and reading to files that changed. Lines are numbered where they are read, without a shuffle.
    """
    return log_source.lines(spark, root, pattern, paths).drop("generation")


def relevant(value: Column) -> Column:
    return reduce(lambda a, b: a | b, (value.contains(m) for m in MARKERS), value.contains("\\"))


def _texts(*names: str) -> str:
    return ",".join(f"{n}:string" for n in names)


_USAGE = f"struct<{_texts(*(a for aliases in ALIASES.values() for a in aliases))}>"
_RESULT = f"struct<{_texts('model', 'model_name', *TIMES)},usage:{_USAGE}>"
_INFO = f"struct<{_texts('model', 'model_name')},last_token_usage:{_USAGE},total_token_usage:{_USAGE}>"
_PAYLOAD_TEXTS = ("type", "name", "id", "session_id", "cwd", "originator", "service_tier", "source", "model_context_window", "model", "model_name", "model_slug", "model_id", "requested_model", "default_model", "forked_from_id", "parent_thread_id")
#: A line as far as it is read; what is no object where one belongs is absent.
LINE = f"{_texts('type', *TIMES, 'model', 'model_name', 'forked_from_id', 'parent_thread_id')},usage:{_USAGE},{','.join(f'{w}:{_RESULT}' for w in WRAPPERS)},payload:struct<{_texts(*_PAYLOAD_TEXTS)},git:struct<branch:string>,info:{_INFO}>"


def parsed(value: Column) -> Column:
    """The fields of a line, parsed once; all values as text."""
    return F.from_json(value, f"struct<{LINE}>")


def _at(line: Column, path: str) -> Column:
    if path.startswith("payload.source."):
        return F.get_json_object(line["payload"]["source"], "$." + path.removeprefix("payload.source."))
    for field in path.split("."):
        line = line[field]
    return line


def _name(text: Column) -> Column:
    """A text that can be an identity."""
    return F.when((text != "") & (F.octet_length(text) <= ID_BYTES), text)


def lenient(text: Column) -> Column:
    """A whole number written as such or as a string of at most 20 digits; anything else is absent."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike("^[0-9]{1,20}$"), trimmed.try_cast("bigint"))


def _counts_of(usage: Column) -> dict[str, Column]:
    """The counts of a usage object as they are written."""
    return {n: F.coalesce(*[lenient(usage[a]) for a in aliases]) for n, aliases in ALIASES.items()}


def counters(there: Column, u: dict[str, Column]) -> Column:
    """Counts of a usage object, if it is there: cached is at most the input and needs it; a total of zero or none is the sum of its parts."""
    cached = F.when(u["cached"].isNotNull() & u["input"].isNotNull(), F.least(u["cached"], u["input"]))
    total = F.when(u["total"] > 0, u["total"]).otherwise(u["input"] + u["output"] + u["reasoning"])
    return F.when(there, F.struct(*[c.alias(n) for n, c in (u | {"cached": cached, "total": total}).items()]))


def _read_moment(raw: Column) -> dict[str, Column]:
    """A time as it is written: a number, or the whole seconds of a text and its fraction."""
    written = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$")
    return {
        "number": F.when(raw.rlike("^-?[0-9]{1,18}$"), raw.try_cast("bigint")),
        "whole": F.when(written, F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.upper(raw), r"\.[0-9]+", "")))),
        "fraction": F.when(raw.contains("."), F.rpad(F.regexp_extract(raw, r"\.([0-9]{1,9})", 1), 9, "0").try_cast("bigint")),
    }


def _as_moment(t: dict[str, Column]) -> Column:
    number, millis = t["number"], t["number"] > 10**12
    seconds = F.when(number.isNotNull(), F.when(millis, F.floor(number / 1000)).otherwise(number)).otherwise(t["whole"]).cast("bigint")
    nanos = F.when(number.isNotNull(), F.when(millis, F.pmod(number, F.lit(1000)) * 1_000_000).otherwise(0)).otherwise(F.coalesce(t["fraction"], F.lit(0))).cast("bigint")
    in_range = seconds.between(-62_167_219_200, 253_402_300_799)
    return F.when(in_range, F.struct(seconds.alias("seconds"), nanos.alias("nanos")))


def moment(raw: Column) -> Column:
    """(seconds, nanos) of RFC 3339 text or of a whole number (over 1e12: milliseconds); null where it is neither."""
    return _as_moment(_read_moment(raw))


def tool_activity(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("terminal")
    for activity, marks in TOOLS[::-1]:
        out = F.when(reduce(lambda a, b: a | b, (low.contains(m) for m in marks)), activity).otherwise(out)
    return F.when(name.isNotNull(), out)


def tool_call(value: Column) -> Column:
    """The tool that a line names: any kind that holds a marker of calls, or a response item with a name."""
    kind, inner, name = _at(value, "type"), _at(value, "payload.type"), _at(value, "payload.name")
    told = F.lower(F.coalesce(inner, kind))
    marked = reduce(lambda a, b: a | b, (told.contains(m) for m in TOOL_KINDS))
    named = (kind == "response_item") & (name != "")
    is_call = _at(value, "payload").isNotNull() & F.coalesce(marked | named, F.lit(False))
    said = F.trim(F.coalesce(F.when(name != "", name), inner, F.lit("unknown")))
    return F.when(is_call, F.when(said == "", F.lit("unknown")).otherwise(said))


def model_key(text: Column) -> Column:
    """A model's own name where it is a plain key, else a digest of it."""
    plain = text.rlike(r"^[A-Za-z0-9._:/+-]{1,128}$")
    return F.when(F.trim(text) == "", None).when(plain, text).otherwise(F.concat(F.lit("unknown_"), F.substring(F.sha2(text, 256), 1, 32)))


def told(lines: DataFrame) -> DataFrame:
    """What each relevant line says: usage, time, and what the file carries on from it.

    What is read from a text stands in a select of its own, so it is read once and not again for each use of it.
    """
    v = F.col("line")
    at = lambda p: _at(v, p)
    first = lambda *paths: F.coalesce(*[F.when(at(p) != "", at(p)) for p in paths])
    text = lambda p: F.when(F.trim(at(p)) != "", F.trim(at(p)))
    # the first wrapper that is there decides; a filter is not moved below a generator, so lines are parsed once
    wrapper = F.coalesce(*[at(w) for w in WRAPPERS])
    usages = {"last": at("payload.info.last_token_usage"), "cumulative": at("payload.info.total_token_usage"), "direct": F.coalesce(wrapper["usage"], at("usage"))}
    times = {f"{k}_{n}": of[t] for k, of in (("wrapped", wrapper), ("top", v)) for n, t in enumerate(TIMES)}
    rows = lines.filter(relevant(F.col("value"))).select("file", "relative", "source_offset", F.explode(F.array(parsed(F.col("value")))).alias("line"))
    rows = rows.select(
        "file", "relative", "source_offset", "line",
        F.coalesce((at("type") == "event_msg") & (at("payload.type") == "token_count"), F.lit(False)).alias("counted"), wrapper["usage"].isNotNull().alias("wrapped"),
        *[u.isNotNull().alias(f"has_{k}") for k, u in usages.items()], *[c.alias(f"{k}_{n}") for k, u in usages.items() for n, c in _counts_of(u).items()],
        *[c.alias(f"{k}_{n}") for k, t in times.items() for n, c in _read_moment(t).items()],
        first("model", "model_name").alias("top_model"), F.coalesce(*[F.when(wrapper[n] != "", wrapper[n]) for n in ("model", "model_name")]).alias("wrapped_model"),
        F.array_distinct(F.array_compact(F.array(*[_name(at(p)) for p in PARENTS]))).alias("parents"), text("payload.cwd").alias("cwd"), lenient(at("payload.model_context_window")).alias("window"), tool_call(v).alias("tool"),
    )
    counted, payload, inside = F.col("counted"), at("payload").isNotNull(), ~F.col("counted") & F.col("wrapped")
    of = lambda k: counters((F.col("counted") if k != "direct" else ~F.col("counted")) & F.col(f"has_{k}"), {n: F.col(f"{k}_{n}") for n in COUNTS}).alias(k)
    moments = lambda k: F.coalesce(*[_as_moment({n: F.col(f"{k}_{i}_{n}") for n in ("number", "whole", "fraction")}) for i in range(len(TIMES))])
    strange = F.col("cwd").rlike(r"(^|[/\\])\.{1,2}([/\\]|$)")
    return rows.select(
        "file", "relative", "source_offset", *map(of, usages),
        F.when(counted, first(*COUNT_MODELS)).when(inside, F.coalesce("wrapped_model", "top_model")).when(F.col("has_direct"), F.col("top_model")).alias("explicit"), first(*META_MODELS).alias("meta_model"),
        F.coalesce(F.when(inside, moments("wrapped")), moments("top")).alias("moment"),
        F.coalesce(F.when(at("type").isin("session_meta", "sessionMeta"), _name(at("payload.id"))), _name(at("payload.session_id"))).alias("line_session"),
        F.when(payload & ~F.coalesce(strange, F.lit(False)), F.nullif(F.regexp_extract("cwd", r"([^/\\]+)[/\\]*$", 1), F.lit(""))).alias("line_project"),
        text("payload.originator").alias("line_originator"), text("payload.git.branch").alias("line_branch"), text("payload.service_tier").alias("line_tier"),
        F.when(~at("payload.source").startswith("{"), text("payload.source")).alias("line_source"), F.when(F.col("window") > 0, F.col("window")).alias("line_window"),
        F.when(payload, F.get("parents", 0)).alias("line_parent"), (payload & (F.size("parents") > 1)).alias("line_conflict"), tool_activity(F.col("tool")).alias("activity"),
        F.lit(0).cast("bigint").alias("emitted_before"), *[F.lit(0).cast("bigint").alias(f"pending_{a}") for a in ACTIVITIES],
    )


def saying(rows: DataFrame) -> DataFrame:
    """Facts of lines but those with usage and no valid time: these say nothing. A state is kept."""
    uses = F.coalesce("last", "cumulative", "direct").isNotNull()
    return rows.filter(~uses | F.col("moment").isNotNull() | (F.col("source_offset") < 0))


def facts(lines: DataFrame) -> DataFrame:
    """What each relevant line says that says something. What is stored first can be told, and filtered as it is read."""
    return saying(told(lines))


def session_hint() -> Column:
    """What a file's lines are of where none names a session: its stem, or a digest of a name that can be no identity."""
    stem = F.regexp_extract("relative", r"([^/]+)\.[^./]+$", 1)
    return F.coalesce(_name(stem), F.concat(F.lit("file_"), F.substring(F.sha2(F.col("relative"), 256), 1, 32)))


def in_stretches(rows: DataFrame) -> DataFrame:
    """Rows with the stretch of their file that they stand in."""
    return rows.withColumn(STRETCH, F.floor(F.col("source_offset") / STRETCH_BYTES).cast("bigint"))


def grown() -> Column:
    """What cumulative counts grew by since the previous ones; a count that is new or fell counts whole."""
    now, previous = F.col("cumulative"), F.col("previous")
    return F.struct(*[F.when(previous[n].isNull() | (now[n] < previous[n]), now[n]).otherwise(now[n] - previous[n]).alias(n) for n in COUNTS])


def uses_tokens() -> Column:
    return F.coalesce(F.greatest(*[F.coalesce(F.col("usage")[n], F.lit(0)) for n in COUNTS]) > 0, F.lit(False))


def clash() -> Column:
    """A line names two parents, another one than the first of its file, or its own session."""
    first_parent = F.col("first_parent")
    itself = F.coalesce(F.coalesce("line_parent", first_parent) == F.col("session_id"), F.lit(False))
    return F.col("line_conflict") | itself | F.coalesce(F.col("line_parent") != first_parent, F.lit(False))


def _followed(rows: DataFrame) -> DataFrame:
    """Facts with usage, deltas, and everything carried along each file."""
    follow = lambda rows, values: along(rows, ("file",), "source_offset", values)
    rows = follow(saying(stored(in_stretches(rows))), {
        "previous": ("last_before", F.col("cumulative")), "first_parent": ("first", F.col("line_parent")), "started": ("sum", F.col("emitted_before")),
        **{name: ("last", F.col(line)) for line, name in CARRIED.items() if line != "line_model"},
    })
    rows = rows.withColumn("usage", F.coalesce("last", F.when(F.col("cumulative").isNotNull(), grown()), "direct"))
    rows = rows.withColumn("emits", (F.col("source_offset") >= 0) & uses_tokens())
    # a line that emits names its model, else its metadata do; a line of zero usage has metadata alone
    rows = rows.withColumn("line_model", model_key(F.coalesce(F.when(F.col("emits"), F.col("explicit")), F.col("meta_model"))))
    rows = rows.withColumn("session_id", F.coalesce("session_id", session_hint()))
    rows = rows.withColumns({"parent_session_id": F.coalesce("line_parent", "first_parent"), "clash": clash()})
    rows = follow(rows, {"model": ("last", F.col("line_model")), "lineage_conflict": ("max", F.col("clash")), "batch": ("sum_before", F.col("emits").cast("bigint"))})
    rows = rows.withColumn("ordinal", F.col("batch") + F.col("started"))
    within = Window.partitionBy("file", "batch")
    return rows.withColumns({f"activity_{a}": (F.count_if(F.col("activity") == a).over(within) + F.sum(f"pending_{a}").over(within)).cast("bigint") for a in ACTIVITIES})


def observations(lines: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row for each line that uses tokens, with what the file said before it; `state` is where files were left before."""
    rows = told(lines)
    return observed(_followed(rows if state is None else rows.unionByName(state)).filter("emits"))


def observed(out: DataFrame, *more: str) -> DataFrame:
    """Followed facts that use tokens in the columns of observations, and more of theirs."""
    flag = F.when(F.col("usage.input").isNull(), "unavailable").when(F.col("usage.input") > LONG, "yes").otherwise("no")
    cumulative = F.when(F.col("cumulative").isNotNull(), F.struct(*[F.col("cumulative")[n].alias(f"{n}_tokens") for n in COUNTS]))
    return out.select(
        "file", "relative", "source_offset", "ordinal", F.col("moment.seconds").alias("timestamp_seconds"), F.col("moment.nanos").alias("timestamp_nanos"),
        "session_id", "parent_session_id", "lineage_conflict", F.coalesce("model", F.lit("unknown")).alias("model"), F.col("model").isNull().cast("bigint").alias("fallback_model"),
        *[F.col("usage")[n].alias(f"{n}_tokens") for n in COUNTS], cumulative.alias("cumulative"), flag.alias("long_context"),
        "project_alias", "originator", "branch", "service_tier", "source_alias", "context_window", *[f"activity_{a}" for a in ACTIVITIES], *more,
    )


def state_after(lines: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """A row of facts for each file that stands for all of it so far: carried values, baseline, open activities, events emitted."""
    rows = told(lines)
    rows = _followed(rows if state is None else rows.unionByName(state))
    end = rows.groupBy("file").agg(
        F.max("source_offset").alias("at"), F.max_by("relative", "source_offset").alias("relative"), F.max_by("cumulative", F.when(F.col("cumulative").isNotNull(), F.col("source_offset"))).alias("cumulative"),
        *[F.max_by(name, F.when(F.col(name).isNotNull(), F.col("source_offset"))).alias(line) for line, name in CARRIED.items() if line not in ("line_session", "line_model")],
        F.max_by("line_session", F.when(F.col("line_session").isNotNull(), F.col("source_offset"))).alias("line_session"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("source_offset"))).alias("meta_model"),
        F.max("first_parent").alias("line_parent"), F.max("lineage_conflict").alias("line_conflict"), F.max(F.col("ordinal") + F.col("emits").cast("bigint")).alias("emitted_before"),
        *[F.max_by(F.when(F.col("emits"), F.lit(0)).otherwise(F.col(f"activity_{a}")), "source_offset").alias(f"pending_{a}") for a in ACTIVITIES],
    )
    shape = told(lines.limit(0)).schema
    given = {"source_offset": F.lit(-1).cast("bigint")}
    return end.select(*[(given.get(f.name, F.col(f.name)) if f.name in given or f.name in end.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])


def prefix_proofs(lines: DataFrame) -> DataFrame:
    """(file, consumed, proof) of the whole lines of each file: the end of the last one, and a digest of all with their places."""
    end = F.col("source_offset") + F.octet_length("value") + 1
    return lines.groupBy("file").agg(F.max(end).alias("consumed"), F.bit_xor(F.xxhash64("source_offset", "value")).alias("proof"))


def tail(lines: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new lines with generation, new checkpoints) against (file, consumed, proof, generation) of an earlier reading.

    A file whose lines up to `consumed` have the same proof has grown: only later lines are new, in its generation. Any
    other known file was rewritten, cut or replaced: all its lines are new, in the next generation.
    """
    end = F.col("source_offset") + F.octet_length("value") + 1
    known = met(lines, checkpoints.select("file", F.col("consumed").alias("was"), F.col("proof").alias("told"), F.col("generation").alias("old")), ("file",), "source_offset", "left")
    again = known.filter(F.col("was").isNotNull() & (end <= F.col("was"))).groupBy("file").agg(F.max(end).alias("upto"), F.bit_xor(F.xxhash64("source_offset", "value")).alias("now"))
    judged = met(known, again, ("file",), "source_offset", "left")
    same = F.coalesce((F.col("upto") == F.col("was")) & (F.col("now") == F.col("told")), F.lit(False))
    generation = F.when(F.col("was").isNull(), F.lit(0)).when(same, F.col("old")).otherwise(F.col("old") + 1).cast("int")
    fresh = judged.withColumns({"same": same, "generation": generation}).filter(~F.col("same") | (F.col("source_offset") >= F.col("was"))).select(*lines.columns, "generation")
    marks = judged.withColumn("generation", generation).groupBy("file").agg(F.max("generation").alias("generation"))
    return fresh, prefix_proofs(lines).join(marks, "file")


def canonical_events(observed: DataFrame) -> DataFrame:
    """Observations that can be counted, with evidence and replay signature: no cumulative count is less than its delta."""
    counts = [f"{n}_tokens" for n in COUNTS]
    covers = reduce(lambda a, b: a & b, (F.coalesce(F.col("cumulative")[c] >= F.col(c), F.lit(True)) for c in counts))
    positive = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in counts]) > 0
    strong = F.coalesce(F.col("cumulative.total_tokens").isNotNull(), F.lit(False))
    return observed.filter(positive & covers).withColumns({"evidence": F.when(strong, "strong").otherwise("weak"), "replay_signature": replay_signature("cumulative")})
