"""Rate-limit windows as a keyed state machine: one state a window, samples in any batches.

A sample is accepted where it is later than all accepted before it; repeated and stale ones change nothing. Of samples of
one moment within a batch the smallest id counts. The state holds the last accepted sample, the epoch, the sequence and
the epoch's maxima; ids of epochs and transitions are made from them by DataFrame functions. `transitions` steps through
a window in one call; `WindowStore` keeps the same state in generations and judges a batch of all windows by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tallymill.operators.quota import BASE, KEY, SAMPLE, THRESHOLDS, epoch_id, judged, transition_id, with_maxima
from tallymill.streaming.generations import Generations

_SAMPLE = {
    "observation_id": "bigint", "used_ppm": "bigint", "remaining_ppm": "bigint", "unit_id": "string", "used_units": "bigint", "capacity_units": "bigint",
    "advertised_resets_at_ms": "bigint", "observed_at_ms": "bigint", "provider_epoch_id": "string",
}
_MORE = {"epoch": "bigint", "sequence": "bigint", "epoch_first": "bigint", "max_ppm": "bigint", "max_ppm_observation": "bigint", "max_units": "bigint", "max_units_observation": "bigint", "max_unit_id": "string"}
#: The state of a window: the last accepted sample, and what the epoch amounts to so far.
STATE = ", ".join(f"{n} {t}" for n, t in {**_SAMPLE, **_MORE}.items())
_NAMES = (*_SAMPLE, *_MORE)
_TOLD = (
    "observed_at_ms bigint, observation_id bigint, used_ppm bigint, quality string, confidence string, fresh_until_ms bigint, stale_after_ms bigint, signal string, reset_kind string, allowance_change string, "
    "transition_confidence string, occurred_at_ms bigint, after_ms bigint, at_or_before_ms bigint, epoch bigint, sequence bigint, epoch_first bigint, previous_first bigint, pre_observation_id bigint, "
    "max_ppm bigint, max_ppm_observation bigint, max_units bigint, max_units_observation bigint, max_unit_id string"
)


def _signal(now: Row, was: dict, thresholds: tuple[int | None, int | None, int | None]) -> str | None:
    """What tells of a reset, if anything does: by hand, another epoch of the provider, explicitly, or by thresholds."""
    if now.reset_evidence == "manual_or_banked":
        return "manual"
    if now.provider_epoch_id is not None and was["provider_epoch_id"] is not None and now.provider_epoch_id != was["provider_epoch_id"]:
        return "provider_epoch"
    if now.reset_evidence in ("explicit_provider", "explicit_local"):
        return "explicit"
    if now.semantics != "fixed" or now.quality in ("conflict", "unknown") or now.confidence in ("low", "unknown"):
        return None
    used, before, left, rest = now.used_ppm, was["used_ppm"], now.remaining_ppm, was["remaining_ppm"]
    fell = (used is not None and before is not None and used < before) or (left is not None and rest is not None and left > rest)
    most, least, drop = thresholds
    fell = fell and (most is None or (used is not None and used <= most)) and (least is None or (left is not None and left >= least))
    fell = fell and (drop is None or (used is not None and before is not None and before - used >= drop))
    if not fell:
        return None
    told, boundary = now.advertised_resets_at_ms, was["advertised_resets_at_ms"]
    if told is None or boundary is None:
        return "threshold_unknown"
    return "threshold_advanced" if told > boundary else None


def _allowance(now: Row, was: dict) -> str | None:
    if now.capacity_units is None or was["capacity_units"] is None:
        return None
    if now.unit_id is not None and was["unit_id"] is not None and now.unit_id != was["unit_id"]:
        return "unit_changed"
    return "increased" if now.capacity_units > was["capacity_units"] else "decreased" if now.capacity_units < was["capacity_units"] else None


def _best(state: dict, now: Row) -> None:
    """The epoch's maxima with this sample; one in another unit clears that of units, and the next starts anew."""
    if now.used_ppm is not None and (state["max_ppm"] is None or now.used_ppm > state["max_ppm"]):
        state |= {"max_ppm": now.used_ppm, "max_ppm_observation": now.observation_id}
    if now.unit_id is None or now.used_units is None:
        return
    if state["max_unit_id"] is not None and state["max_unit_id"] != now.unit_id:
        state |= {"max_units": None, "max_units_observation": None, "max_unit_id": None}
    elif state["max_units"] is None or now.used_units > state["max_units"]:
        state |= {"max_units": now.used_units, "max_units_observation": now.observation_id, "max_unit_id": now.unit_id}


def step(state: dict | None, now: Row, thresholds: tuple[int | None, int | None, int | None] = THRESHOLDS) -> tuple[dict, dict]:
    """(state, what the sample tells) after an accepted sample; no state before the first."""
    fresh = dict.fromkeys(_NAMES) | {"epoch": 0, "sequence": 0, "epoch_first": now.observation_id}
    was = state if state is not None else fresh
    signal = _signal(now, was, thresholds) if state is not None else None
    change = _allowance(now, was) if state is not None else None
    boundary, at = was["advertised_resets_at_ms"], was["observed_at_ms"]
    exact = now.reset_occurred_at_ms if at is not None and now.reset_occurred_at_ms is not None and now.reset_occurred_at_ms > at else None
    kind = None
    if signal is not None:
        told = now.observed_at_ms if exact is None else exact
        kind = "manual_or_banked" if signal == "manual" else "unknown" if signal == "threshold_unknown" or boundary is None else "scheduled" if told >= boundary else "early"
    changed = kind is not None or change is not None
    doubtful = signal == "threshold_unknown" or (signal == "threshold_advanced" and now.quality == "partial")
    between = changed and not (kind is not None and exact is not None)
    new = dict(was)
    if kind is not None:
        new |= {"epoch": was["epoch"] + 1, "epoch_first": now.observation_id, **dict.fromkeys(n for n in _MORE if n.startswith("max_"))}
    new["sequence"] = was["sequence"] + changed
    _best(new, now)
    out = {
        "signal": signal, "reset_kind": kind, "allowance_change": change, "transition_confidence": ("low" if doubtful else now.confidence) if changed else None,
        "occurred_at_ms": exact if kind is not None else None, "after_ms": at if between else None, "at_or_before_ms": now.observed_at_ms if between else None,
        "previous_first": was["epoch_first"] if state is not None else None, "pre_observation_id": was["observation_id"],
    }
    new |= {n: now[n] for n in _SAMPLE}
    return new, out


class Windows(StatefulProcessor):
    """One window of one scope."""

    def __init__(self, thresholds: tuple[int | None, int | None, int | None]):
        self.thresholds = thresholds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        state = dict(zip(_NAMES, self.state.get(), strict=True)) if self.state.exists() else None
        for now in sorted(rows, key=lambda r: (r.observed_at_ms, r.observation_id)):
            if state is not None and now.observed_at_ms <= state["observed_at_ms"]:
                continue
            state, told = step(state, now, self.thresholds)
            every = {**now.asDict(), **state, **told}
            yield Row(**dict(zip(KEY, key, strict=True)), **{c.split()[0]: every[c.split()[0]] for c in _TOLD.split(", ")})
        if state is not None:
            self.state.update(tuple(state[n] for n in _NAMES))

    def close(self) -> None:
        pass


def transitions(samples: DataFrame, thresholds: tuple[int | None, int | None, int | None] = THRESHOLDS) -> DataFrame:
    """A stream of samples as accepted ones with transition, epoch, ids and the running maxima of their epoch."""
    schema = samples.sparkSession.createDataFrame([], f"{', '.join(f'{k} string' for k in KEY)}, {_TOLD}").schema
    told = samples.groupBy(*KEY).transformWithState(statefulProcessor=Windows(thresholds), outputStructType=schema, outputMode="Append", timeMode="None")
    named = told.withColumns({"epoch_id": epoch_id(F.col("epoch_first")), "previous_epoch_id": F.when(F.col("previous_first").isNotNull(), epoch_id(F.col("previous_first")))})
    changed = F.col("reset_kind").isNotNull() | F.col("allowance_change").isNotNull()
    return named.withColumn("transition_id", F.when(changed, transition_id())).drop("epoch_first", "previous_first")


_BEST = ("max_ppm", "max_ppm_observation", "max_units", "max_units_observation", "max_unit_id")
_KEPT = (*KEY, *SAMPLE, *BASE, *_BEST)


class WindowStore:
    """What each window's samples told and where it stands, a generation for each batch; a window may have any number of samples."""

    def __init__(self, spark: SparkSession, path: str, thresholds: tuple[int | None, int | None, int | None] = THRESHOLDS):
        self.spark, self.path, self.thresholds, self.generations = spark, path, thresholds, Generations(spark, path)

    def _part(self, name: str, batch: int) -> str:
        return f"{self.path}/delta-{batch}/{name}"

    def apply(self, samples: DataFrame, batch: int) -> None:
        """Take samples in; a batch that was applied before changes nothing."""
        last = self.generations.active()
        if batch <= last:
            return
        state = self.spark.read.parquet(self._part("state", last)) if last >= 0 else None
        rows = judged(samples, self.thresholds, state).filter(F.col("base_epoch").isNull())
        if state is not None:
            # the epoch's maxima so far stand before its rows, as the samples that they are of
            at = {"epoch": F.col("base_epoch"), "base_epoch": F.col("base_epoch")}
            ppm = {"observation_id": "max_ppm_observation", "used_ppm": "max_ppm"}
            units = {"observation_id": "max_units_observation", "unit_id": "max_unit_id", "used_units": "max_units"}
            for back, of in ((1, ppm), (0, units)):
                stand = state.select(*KEY, (F.col("observed_at_ms") - back).alias("observed_at_ms"), *[c.alias(n) for n, c in at.items()], *[F.col(c).alias(n) for n, c in of.items()])
                rows = rows.unionByName(stand, allowMissingColumns=True)
        with_maxima(rows).filter(F.col("base_epoch").isNull()).drop(*BASE).write.mode("overwrite").parquet(self._part("told", batch))
        now = self._told([batch]).withColumns({"base_epoch": F.col("epoch"), "base_sequence": F.col("sequence"), "base_first": F.col("epoch_first")}).select(*_KEPT)
        every = now if state is None else now.unionByName(state.select(*_KEPT))
        newest = every.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in _KEPT if c not in KEY]), "observed_at_ms").alias("m"))
        newest.select(*KEY, "m.*").write.mode("overwrite").parquet(self._part("state", batch))
        self.generations.commit(f"delta-{batch}")

    def _told(self, batches: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[self._part("told", b) for b in batches])

    def told(self) -> DataFrame:
        """The accepted samples of all batches (one at least), in the columns of `transitions`."""
        numbers = [int(p.rsplit("-", 1)[1]) for p in self.generations.parts()]
        told = [c.split()[0] for c in _TOLD.split(", ") if c.split()[0] not in ("epoch_first", "previous_first")]
        return self._told(numbers).select(*KEY, *told, "epoch_id", "previous_epoch_id", "transition_id")
