"""The log parser as a stream: what each file carries is kept from batch to batch, lines may come in any batches.

Lines are parsed by DataFrame functions; what follows a file sees narrow facts alone. `observations` steps through a file
in one call and keeps its state in the state store; `ObservationStore` keeps the same state in generations and follows
all files of a batch stretch by stretch. Both are the fold that the batch parser writes with windows, so the same lines
give the same observations whatever their split.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tallymill.functions.stretches import STRETCH, alike
from tallymill.sources import jsonl
from tallymill.sources.jsonl import ACTIVITIES, CARRIED, COUNTS, LONG
from tallymill.streaming.generations import Generations

_TEXTS = tuple(name for name in CARRIED.values() if name not in ("context_window",))
#: A file's state: carried values, the last cumulative counts, the parent, what was emitted, activities since.
STATE = ", ".join(
    [f"{name} string" for name in _TEXTS]
    + ["context_window bigint"]
    + [f"before_{n} bigint" for n in COUNTS]
    + ["counted boolean, first_parent string, conflict boolean, emitted bigint"]
    + [f"pending_{a} bigint" for a in ACTIVITIES]
)
_START = {**dict.fromkeys((*_TEXTS, "context_window", *(f"before_{n}" for n in COUNTS), "first_parent")), "counted": False, "conflict": False, "emitted": 0, **{f"pending_{a}": 0 for a in ACTIVITIES}}
_NAMES = tuple(c.split()[0] for c in STATE.split(", "))


def _delta(now: Row, state: dict) -> list[int | None]:
    """What cumulative counts grew by; a count that is new or fell counts whole."""
    out = []
    for n in COUNTS:
        was = state[f"before_{n}"] if state["counted"] else None
        so_far = now[f"whole_{n}"]
        out.append(so_far if was is None or so_far is None or so_far < was else so_far - was)
    return out


def step(state: dict, row: Row) -> dict | None:
    """Take one line's facts into the state; the observation where the line uses tokens."""
    usage = [row[f"given_{n}"] for n in COUNTS] if row.given else _delta(row, state) if row.whole else None
    emits = usage is not None and max(c or 0 for c in usage) > 0
    if row.whole:
        state |= {"counted": True, **{f"before_{n}": row[f"whole_{n}"] for n in COUNTS}}
    for line, name in CARRIED.items():
        said = (row.named if emits else row.plain) if name == "model" else row[line]
        if said is not None:
            state[name] = said
    session = state["session_id"] if state["session_id"] is not None else row.hint
    if state["first_parent"] is None:
        state["first_parent"] = row.line_parent
    parent = row.line_parent if row.line_parent is not None else state["first_parent"]
    state["conflict"] = bool(state["conflict"] or row.line_conflict or (parent is not None and parent == session) or (row.line_parent is not None and row.line_parent != state["first_parent"]))
    if row.activity is not None:
        state[f"pending_{row.activity}"] += 1
    if not emits:
        return None
    counts = dict(zip(COUNTS, usage, strict=True))
    out = {
        "file": row.file, "relative": row.relative, "source_offset": row.source_offset, "ordinal": state["emitted"], "timestamp_seconds": row.seconds, "timestamp_nanos": row.nanos,
        "session_id": session, "parent_session_id": parent, "lineage_conflict": state["conflict"], "model": state["model"] or "unknown", "fallback_model": int(state["model"] is None),
        **{f"{n}_tokens": c for n, c in counts.items()}, "whole": row.whole, **{f"whole_{n}": row[f"whole_{n}"] for n in COUNTS},
        "long_context": "unavailable" if counts["input"] is None else "yes" if counts["input"] > LONG else "no",
        **{k: state[k] for k in ("project_alias", "originator", "branch", "service_tier", "source_alias", "context_window")}, **{f"activity_{a}": state[f"pending_{a}"] for a in ACTIVITIES},
    }
    state |= {"emitted": state["emitted"] + 1, **{f"pending_{a}": 0 for a in ACTIVITIES}}
    return out


class LogParser(StatefulProcessor):
    """One file in one generation. Lines of a batch are taken in order of their place."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        state = dict(zip(_NAMES, self.state.get(), strict=True)) if self.state.exists() else dict(_START)
        for row in sorted(rows, key=lambda r: r.source_offset):
            out = step(state, row)
            if out is not None:
                yield Row(generation=key[1], **out)
        self.state.update(tuple(state[n] for n in _NAMES))

    def close(self) -> None:
        pass


def observations(lines: DataFrame) -> DataFrame:
    """The observations of a stream of lines (with `generation`), in the batch parser's columns and `generation`."""
    told = jsonl.facts(lines.withColumn("file", F.struct("file", "generation")))
    given, whole = F.coalesce("last", F.when(F.col("cumulative").isNull(), F.col("direct"))), F.col("cumulative")
    facts = told.select(
        F.col("file.file").alias("file"), F.col("file.generation").alias("generation"), "relative", "source_offset", F.col("moment.seconds").alias("seconds"), F.col("moment.nanos").alias("nanos"),
        given.isNotNull().alias("given"), *[given[n].alias(f"given_{n}") for n in COUNTS], whole.isNotNull().alias("whole"), *[whole[n].alias(f"whole_{n}") for n in COUNTS],
        jsonl.model_key(F.coalesce("explicit", "meta_model")).alias("named"), jsonl.model_key(F.col("meta_model")).alias("plain"), jsonl.session_hint().alias("hint"),
        *[c for c in CARRIED if c != "line_model"], "line_parent", "line_conflict", "activity",
    )
    spark = lines.sparkSession
    empty = spark.createDataFrame([], "file string, relative string, source_offset bigint, value string")
    schema = spark.createDataFrame([], "generation int").schema
    columns = jsonl.observations(empty).schema
    flat = spark.createDataFrame([], ", ".join(["whole boolean", *(f"whole_{n} bigint" for n in COUNTS)])).schema
    for field in (*flat, *(c for c in columns if c.name != "cumulative")):
        schema = schema.add(field.name, field.dataType)
    out = facts.groupBy("file", "generation").transformWithState(statefulProcessor=LogParser(), outputStructType=schema, outputMode="Append", timeMode="None")
    rebuilt = F.when(F.col("whole"), F.struct(*[F.col(f"whole_{n}").alias(f"{n}_tokens") for n in COUNTS]))
    return out.withColumn("cumulative", rebuilt).select(*[c.name for c in columns], "generation")


KEY = ("file", "generation")
#: What a line may say of its file and carry on, but for the session and the model: by the name of the fact.
_PLAIN = {line: name for line, name in CARRIED.items() if name not in ("session_id", "model")}
_START_ROW = -1


class ObservationStore:
    """What the lines of each batch tell and where each file stands, a generation for each batch; a file may have any number of lines.

    A batch is parsed once. What a file carries goes from stretch to stretch as a row each, in two rounds: first what
    lines say by themselves (counts so far, session, first parent), then what follows from it (model, conflicts, events
    so far, open activities). The state of the batches before stands ahead of a file's first stretch in both.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.generations = spark, path, Generations(spark, path)

    def _part(self, name: str, batch: int) -> str:
        return f"{self.path}/delta-{batch}/{name}"

    def _kept(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._part(name, batch))
        return self.spark.read.schema(rows.schema).parquet(self._part(name, batch))

    def apply(self, lines: DataFrame, batch: int) -> None:
        """Take lines (with `generation`) in; a batch that was applied before changes nothing."""
        last = self.generations.active()
        if batch <= last:
            return
        state = self.spark.read.parquet(self._part("state", last)) if last >= 0 else None
        facts = self._kept(_narrow(lines), "facts", batch)
        # lines with usage and no valid time say nothing
        facts = facts.filter((F.col("given").isNull() & F.col("cumulative").isNull()) | F.col("moment").isNotNull())
        rows = self._kept(_within(facts.unionByName(_said_before(facts, state), allowMissingColumns=True)), "rows", batch)
        ends = self._kept(_chained(rows.filter("ends"), state), "ends", batch)
        jsonl.observed(_whole(rows.filter("emits"), ends), "generation").write.mode("overwrite").parquet(self._part("told", batch))
        ends.filter("newest").select(*KEY, "relative", "cumulative", "session", "first_parent", "until.*").write.mode("overwrite").parquet(self._part("state", batch))
        self.generations.commit(f"delta-{batch}")
        for name in ("facts", "rows", "ends"):
            self.generations.drop(f"delta-{batch}/{name}")

    def observations(self) -> DataFrame:
        """The observations of all batches (one at least), in the batch parser's columns and `generation`."""
        return self.spark.read.parquet(*[self._part("told", int(p.rsplit("-", 1)[1])) for p in self.generations.parts()])


def _narrow(lines: DataFrame) -> DataFrame:
    """What the lines of a batch say, each in its file, generation and stretch."""
    told = jsonl.in_stretches(jsonl.told(lines.withColumn("file", F.struct("file", "generation"))))
    return told.select(
        F.col("file.file").alias("file"), F.col("file.generation").alias("generation"), "relative", STRETCH, "source_offset", "moment",
        F.coalesce("last", F.when(F.col("cumulative").isNull(), F.col("direct"))).alias("given"), "cumulative",
        jsonl.model_key(F.coalesce("explicit", "meta_model")).alias("named"), jsonl.model_key(F.col("meta_model")).alias("plain"),
        "line_session", *_PLAIN, "line_parent", "line_conflict", "activity", F.lit(False).alias("before"),
    )


def _along(upto: int = 0):
    return Window.partitionBy(*KEY).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, upto)


def _said_before(facts: DataFrame, state: DataFrame | None) -> DataFrame:
    """A row ahead of each stretch that says what its file said by itself before it."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("source_offset"))
    said = facts.groupBy(*KEY, STRETCH).agg(
        F.max("relative").alias("relative"), F.max_by("cumulative", at("cumulative")).alias("cumulative"),
        F.max_by("line_session", at("line_session")).alias("line_session"), F.min_by("line_parent", at("line_parent")).alias("line_parent"),
    )
    if state is not None:
        said = said.unionByName(state.select(*KEY, F.lit(_START_ROW).cast("bigint").alias(STRETCH), "relative", "cumulative", F.col("session").alias("line_session"), F.col("first_parent").alias("line_parent")))
    last = {c: F.last(c, ignorenulls=True).over(_along(-1)) for c in ("cumulative", "line_session")}
    carried = said.withColumns({**last, "line_parent": F.first("line_parent", ignorenulls=True).over(_along(-1))}).filter(F.col(STRETCH) > _START_ROW)
    return carried.withColumns({"source_offset": F.col(STRETCH) * jsonl.STRETCH_BYTES - 1, "before": F.lit(True), "line_conflict": F.lit(False)})


def _within(rows: DataFrame) -> DataFrame:
    """Rows that use tokens or end a stretch, followed along their stretch."""
    here = Window.partitionBy(*KEY, STRETCH).orderBy("source_offset")
    upto, earlier = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, window=upto: F.last(c, ignorenulls=True).over(window)
    rows = rows.withColumns({
        "previous": last("cumulative", earlier), "first_parent": F.first("line_parent", ignorenulls=True).over(upto), "session": last("line_session"),
        "ends": F.lead("source_offset").over(here).isNull(), **{name: last(line) for line, name in _PLAIN.items()},
    })
    rows = rows.withColumns({"usage": F.coalesce("given", F.when(F.col("cumulative").isNotNull(), jsonl.grown())), "session_id": F.coalesce("session", jsonl.session_hint()), "parent_session_id": F.coalesce("line_parent", "first_parent")})
    rows = rows.withColumns({"emits": ~F.col("before") & jsonl.uses_tokens(), "clash": ~F.col("before") & jsonl.clash()})
    rows = rows.withColumns({
        "model": last(F.when(F.col("emits"), F.col("named")).otherwise(F.col("plain"))), "lineage_conflict": F.max("clash").over(upto),
        "emitted": F.count_if("emits").over(upto), "counted": F.struct(*[F.count_if(F.col("activity") == a).over(upto).alias(a) for a in ACTIVITIES]),
    })
    rows = rows.withColumn("closed", last(F.when(F.col("emits"), F.col("counted")), earlier)).filter("emits OR ends")
    return rows.select(
        *KEY, "relative", STRETCH, "source_offset", "moment", "usage", "cumulative", "previous", "session", "session_id", "first_parent", "parent_session_id",
        "lineage_conflict", "model", *_PLAIN.values(), "emits", "ends", "emitted", "counted", "closed",
    )


def _chained(ends: DataFrame, state: DataFrame | None) -> DataFrame:
    """What a file amounts to at the end of each stretch (`until`), before it (`ahead`), and which stretch is its newest."""
    carried = ("model", *_PLAIN.values())
    rows = ends.select(
        *KEY, "relative", STRETCH, F.coalesce("cumulative", "previous").alias("cumulative"), "session", "first_parent", "lineage_conflict", *carried,
        "emitted", "counted", F.when(F.col("emits"), F.col("counted")).otherwise(F.col("closed")).alias("closed"),
    )
    if state is not None:
        pending = F.struct(*[F.col(f"pending_{a}").alias(a) for a in ACTIVITIES])
        rows = rows.unionByName(state.select(*KEY, "relative", F.lit(_START_ROW).cast("bigint").alias(STRETCH), "cumulative", "session", "first_parent", "lineage_conflict", *carried, "emitted", pending.alias("counted"), F.lit(None).cast(rows.schema["closed"].dataType).alias("closed")))
    rows = rows.withColumns({
        **{c: F.last(c, ignorenulls=True).over(_along()) for c in carried}, "lineage_conflict": F.max("lineage_conflict").over(_along()), "emitted": F.sum("emitted").over(_along()),
        **{f"all_{a}": F.sum(F.col("counted")[a]).over(_along()) for a in ACTIVITIES},
    })
    # activities up to the last event of all stretches so far are told, the others are open
    closed = F.when(F.col("closed").isNotNull(), F.struct(*[(F.col(f"all_{a}") - F.col("counted")[a] + F.col("closed")[a]).alias(a) for a in ACTIVITIES]))
    rows = rows.withColumn("closed", F.last(closed, ignorenulls=True).over(_along()))
    until = F.struct("lineage_conflict", *carried, "emitted", *[(F.col(f"all_{a}") - F.coalesce(F.col("closed")[a], F.lit(0))).alias(f"pending_{a}") for a in ACTIVITIES])
    order = Window.partitionBy(*KEY).orderBy(STRETCH)
    rows = rows.withColumn("until", until).withColumns({"ahead": F.lag("until").over(order), "newest": F.lead(STRETCH).over(order).isNull()})
    return rows.select(*KEY, "relative", STRETCH, "cumulative", "session", "first_parent", "until", "ahead", "newest")


def _whole(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Followed rows with what their file amounts to before their stretch."""
    groups = (*KEY, STRETCH)
    few = ends.filter(F.col(STRETCH) > _START_ROW).select(*[F.col(c).alias(f"of_{c}") for c in groups], "ahead")
    ahead, first = F.col("ahead"), F.col("closed").isNull()
    since = {f"activity_{a}": F.col("counted")[a] - F.coalesce(F.col("closed")[a], F.lit(0)) + F.when(first, F.coalesce(ahead[f"pending_{a}"], F.lit(0))).otherwise(0) for a in ACTIVITIES}
    return rows.join(few, alike(groups)).withColumns({
        "ordinal": F.col("emitted") - 1 + F.coalesce(ahead["emitted"], F.lit(0)), "lineage_conflict": F.col("lineage_conflict") | F.coalesce(ahead["lineage_conflict"], F.lit(False)),
        **{c: F.coalesce(F.col(c), ahead[c]) for c in ("model", *_PLAIN.values())}, **since,
    })
