"""Keeping rollups up to date from a stream of events or of changes: each micro-batch adds its own delta, deltas are compacted.

Rollups add up, so a removed event is a delta of opposite sign: an update is the removal of the old row and the arrival
of the new one, in any batches and any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.measures import METRICS, merged_metrics
from tallymill.operators.rollup import TIME_KEYS, merge, time_rollup
from tallymill.sources.stored import read, write
from tallymill.streaming.generations import Generations


class RollupStore:
    """Deltas of the time rollup below one shared folder, one for each batch, and bases that stand for all up to a batch.

    A batch writes only its own events' buckets. Reading adds the newest base and the deltas after it, so late events and
    removals just change their bucket. Compaction removes what neither this nor the last generation is made of.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        self.spark, self.path, self.every = spark, path, every
        self.generations = Generations(spark, path)

    def active(self) -> int:
        """The newest batch that is whole, -1 for none."""
        return self.generations.active()

    def _sums(self) -> DataFrame:
        parts = [read(self.spark, f"{self.path}/{p}") for p in self.generations.parts()]
        rest = parts[0].limit(0)
        for part in parts[1:]:
            rest = rest.unionByName(part)
        return merge(parts[0], rest)

    def read(self) -> DataFrame:
        return self._sums().filter("event_count > 0")

    def _publish(self, rollup: DataFrame, batch_id: int) -> None:
        write(rollup, f"{self.path}/delta-{batch_id}")
        self.generations.commit(f"delta-{batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.compact()

    def apply(self, events: DataFrame, batch_id: int) -> None:
        """Add a batch once: a batch that ran before is left as it is."""
        if batch_id > self.active():
            self._publish(time_rollup(events), batch_id)

    def apply_changes(self, changes: DataFrame, batch_id: int) -> None:
        """Take a batch of changes once: events with `change`, insert or delete; an update is one of each."""
        if batch_id > self.active():
            # one pass over the batch; what came and what went meet as sums
            told = time_rollup(changes.filter(F.col("change").isin("insert", "delete")), "change")
            signed = [F.when(F.col("change") == "delete", -F.col(m)).otherwise(F.col(m)).alias(m) for m in METRICS]
            self._publish(told.select(*TIME_KEYS, *signed).groupBy(*TIME_KEYS).agg(*merged_metrics()), batch_id)

    def compact(self) -> None:
        """Write a base of all that is whole; buckets that add up to nothing go."""
        last = self.active()
        some = F.greatest(*[F.abs(m) for m in METRICS]) > 0
        write(self._sums().filter(some), f"{self.path}/base-{last}")
        self.generations.commit(f"base-{last}")
        self.generations.prune()


def maintain(events: DataFrame, store: RollupStore, checkpoint: str):
    """Start the query over events, or over changes where they have `change`; availableNow works off what there is and ends."""
    take = store.apply_changes if "change" in events.columns else store.apply
    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
