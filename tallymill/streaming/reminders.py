"""Reminders that come due by themselves: timers in keyed state, driven by the clock of the events.

A lot revision and channel is a key. Its pending reminders wait in its state, with a timer at each due time and one at
expiry. When the watermark (the clock) has passed a timer, all that is due by then is taken at once: what has expired is
counted, the most urgent of the rest is delivered unless one as urgent went before. At expiry the state is cleared.

A call of the state store is a round trip from Python for each key, so very many lots are kept by `ReminderStore` instead:
the same by joins, all keys at once, as a stream's `foreachBatch`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tallymill.streaming.generations import Generations

KEY = ("scope_id", "lot_id", "lot_revision", "channel")
#: Rows of the stream: reminders, receipts of earlier deliveries (without due and expiry), and ticks of the clock (without a lead).
SCHEMA = "at timestamp, scope_id string, lot_id bigint, lot_revision bigint, channel string, lead_seconds bigint, due_at_ms bigint, expires_at_ms bigint"
_OUT = "scope_id string, lot_id bigint, lot_revision bigint, channel string, now_ms bigint, taken bigint, expired bigint, lead_seconds bigint, expires_at_ms bigint, due_at_ms bigint, sent boolean"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
#: A reminder beside its key, by urgency.
_REMINDER = ("lead_seconds", "expires_at_ms", "due_at_ms")


def judge(pending: list[tuple[int, int, int]], done: int | None, now_ms: int) -> tuple[dict | None, list[tuple[int, int, int]], int | None]:
    """(what is told, what stays pending, most urgent lead delivered) for (lead, due, expiry) rows at a moment."""
    due = [p for p in pending if p[1] <= now_ms]
    if not due:
        return None, pending, done
    alive = [p for p in due if p[2] > now_ms]
    best = min(alive, key=lambda p: (p[0], p[2], p[1]), default=None)
    sent = best is not None and (done is None or best[0] < done)
    told = {"taken": len(due), "expired": len(due) - len(alive), "lead_seconds": best and best[0], "expires_at_ms": best and best[2], "due_at_ms": best and best[1], "sent": sent if best else None}
    return told, [p for p in pending if p[1] > now_ms], best[0] if sent else done


class Reminders(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "lead bigint, due bigint, expiry bigint")
        self.done = handle.getValueState("done", "lead bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for row in rows:
            if row.lead_seconds is None:
                continue
            if row.due_at_ms is None:
                done = self.done.get()[0] if self.done.exists() else None
                self.done.update((row.lead_seconds if done is None else min(done, row.lead_seconds),))
                continue
            self.pending.appendValue((row.lead_seconds, row.due_at_ms, row.expires_at_ms))
            # what is due on arrival is taken at the moment of arrival
            for at in (row.due_at_ms, row.expires_at_ms):
                self.handle.registerTimer(max(at, row.at_ms))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        pending = [tuple(p) for p in self.pending.get()] if self.pending.exists() else []
        told, rest, done = judge(pending, self.done.get()[0] if self.done.exists() else None, now)
        if told is None:
            return
        if rest:
            self.pending.put(rest)
            if done is not None:
                self.done.update((done,))
        else:
            self.pending.clear()
            if done is not None and max(p[2] for p in pending) > now:
                self.done.update((done,))
            else:
                self.done.clear()
        yield Row(**dict(zip(KEY, key, strict=True)), now_ms=now, **told)

    def close(self) -> None:
        pass


def processed(stream: DataFrame) -> DataFrame:
    """What each moment of the clock takes of each key (rows as SCHEMA says): counts, the most urgent one, and whether it is sent."""
    timed = stream.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", "0 seconds")
    schema = stream.sparkSession.createDataFrame([], _OUT).schema
    return timed.groupBy(*KEY).transformWithState(statefulProcessor=Reminders(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class ReminderStore:
    """What waits and what was delivered, a generation for each batch; a batch moves the clock to its last moment and takes what is due."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.generations = spark, path, Generations(spark, path)

    def _part(self, name: str, batch: int) -> str:
        return f"{self.path}/delta-{batch}/{name}"

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Take rows (as SCHEMA says) in and judge what is due; a batch that was applied before changes nothing."""
        last = self.generations.active()
        if batch <= last:
            return
        now = rows.agg(F.max(F.unix_millis("at"))).first()[0]
        if now is None:
            return
        some, timed = rows.filter("lead_seconds IS NOT NULL"), F.col("due_at_ms").isNotNull()
        waiting = some.filter(timed).select(*KEY, *_REMINDER)
        done = some.filter(~timed).select(*KEY, "lead_seconds", F.lit(None).cast("bigint").alias("until"))
        if last >= 0:
            waiting, done = (new.unionByName(self.spark.read.schema(new.schema).parquet(self._part(name, last))) for name, new in (("waiting", waiting), ("done", done)))
        due, dead = waiting.filter(F.col("due_at_ms") <= now), F.col("expires_at_ms") <= now
        per = due.groupBy(*KEY).agg(F.count("*").alias("taken"), F.count_if(dead).alias("expired"), F.min(F.when(~dead, F.struct(*_REMINDER))).alias("m"))
        least = done.groupBy(*KEY).agg(F.min("lead_seconds").alias("least"))
        sent = F.when(F.col("lead_seconds").isNotNull(), F.col("least").isNull() | (F.col("lead_seconds") < F.col("least")))
        told = per.select(*KEY, F.lit(now).cast("bigint").alias("now_ms"), "taken", "expired", "m.*").join(least, list(KEY), "left").withColumn("sent", sent)
        told.select(*_COLUMNS).write.mode("overwrite").parquet(self._part("told", batch))
        now_done = self._told([batch]).filter("sent").select(*KEY, "lead_seconds", F.col("expires_at_ms").alias("until"))
        waiting.filter(F.col("due_at_ms") > now).write.mode("overwrite").parquet(self._part("waiting", batch))
        # what was delivered counts until its expiry, a receipt always
        done.unionByName(now_done).filter(F.col("until").isNull() | (F.col("until") > now)).write.mode("overwrite").parquet(self._part("done", batch))
        self.generations.commit(f"delta-{batch}")

    def _told(self, batches: list[int]) -> DataFrame:
        return self.spark.read.schema(self.spark.createDataFrame([], _OUT).schema).parquet(*[self._part("told", b) for b in batches])

    def told(self) -> DataFrame:
        """What each moment of the clock took of each key, in the columns of `processed`."""
        numbers = [int(p.rsplit("-", 1)[1]) for p in self.generations.parts()]
        return self._told(numbers) if numbers else self.spark.createDataFrame([], _OUT)


def counts(told: DataFrame) -> DataFrame:
    """(now_ms, scope_id, taken, expired, delivered, suppressed) of each moment."""
    sums = [F.sum(c).alias(c) for c in ("taken", "expired")]
    return told.groupBy("now_ms", "scope_id").agg(*sums, F.count_if("sent").alias("delivered"), F.count_if(~F.col("sent")).alias("suppressed"))
