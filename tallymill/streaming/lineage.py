"""Replay classes kept up to date while observations and relations arrive, parents after their children's events too.

The store is a forest with an index of it. Each session's row holds its path of ancestors; `below` has a row for each
ancestor of it, so one look-up gives all descendants of a session. A batch changes the classes of its own sessions, of
their children (whose parent's facts changed), and, where a relation moved, of all descendants. Only those are classified
anew: their rows and their parents' are read from their buckets. A session's newest version counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.checkpoints import materialize
from tallymill.operators import lineage
from tallymill.operators.lineage import DEPTH, KEY
from tallymill.streaming.generations import Generations

_NAMES = ", ".join(f"{k} string" for k in KEY)
SCHEMAS = {
    "seen": f"{_NAMES}, parent_session_id string, ordinal bigint, signature string, strong boolean, file_key string, generation bigint, source_offset bigint, fingerprint string, declared_conflict boolean, relation_conflict boolean",
    "said": f"{_NAMES}, low string, high string, said boolean",
    "path": f"{_NAMES}, names array<string>, version bigint",
    "below": f"{_NAMES}, ancestor string, depth int",
    "class": f"{_NAMES}, ordinal bigint, signature string, strong boolean, file_key string, generation bigint, source_offset bigint, fingerprint string, declared_conflict boolean, disposition string, version bigint",
}


class ReplayStore:
    """The store below one shared folder. `read` has, of the last batch, the buckets of observations that it looked at."""

    def __init__(self, spark: SparkSession, path: str, complete: bool = True, buckets: int = 64, every: int = 16):
        self.spark, self.path, self.complete, self.buckets, self.every = spark, path, complete, buckets, every
        self.generations = Generations(spark, path)
        self.read: set[int] = set()

    def _bucket(self, session: str = "session_id") -> Column:
        return F.pmod(F.xxhash64(*KEY[:2], session), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str, kind: str, session: str = "session_id") -> None:
        columns = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
        rows = rows.select(*columns).to(self.spark.createDataFrame([], SCHEMAS[kind]).schema).withColumn("bucket", self._bucket(session))
        # few buckets are written by as many tasks as there are cores for, each session by one
        parts = max(1, -(-2 * self.spark.sparkContext.defaultParallelism // self.buckets))
        dealt = rows.repartition("bucket", F.pmod(F.hash(session), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", session).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}/{kind}")

    def _open(self, kind: str, keys: DataFrame | None = None, session: str = "session_id", more: tuple[str, ...] = ()) -> DataFrame:
        """The rows of a kind: all, or those in the buckets of `keys` (KEY columns) whose `session` is one of them."""
        folders = [f"{self.path}/{p}/{kind}" for p in (*self.generations.parts(), *more)]
        schema = SCHEMAS[kind]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(f"{schema}, bucket int").parquet(f) for f in folders))
        if keys is None:
            return rows.drop("bucket")
        of = [r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers
        rows = rows.filter(F.col("bucket").isin(of)) if of else rows.limit(0)
        if kind == "seen":
            self.read |= set(of)
        return rows.drop("bucket").join(keys.select(*KEY[:2], F.col("session_id").alias(session)), [*KEY[:2], session], "left_semi")

    @staticmethod
    def _merged(said: DataFrame) -> DataFrame:
        return said.groupBy(*KEY).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("said").alias("said"))

    def apply(self, observations: DataFrame, batch_id: int, relations: DataFrame | None = None) -> None:
        """Take a batch of observations, and relations (KEY, parent_session_id, relation_conflict) declared apart; a batch that ran before changes nothing."""
        if batch_id <= self.generations.active():
            return
        folder, self.read = f"delta-{batch_id}", set()
        self._write(observations, folder, "seen")
        now = self.spark.read.schema(SCHEMAS["seen"]).parquet(f"{self.path}/{folder}/seen").drop("bucket")
        told = now.select(*KEY, "parent_session_id", "relation_conflict")
        told = told if relations is None else told.unionByName(relations.select(*told.columns))
        self._write(lineage.declared(told), folder, "said")
        fresh = self.spark.read.schema(SCHEMAS["said"]).parquet(f"{self.path}/{folder}/said").drop("bucket")
        affected = materialize(self._affected(fresh))
        known, facts, walk = self._placed(affected, folder)
        self._write(walk.withColumn("version", F.lit(batch_id).cast("bigint")), folder, "path")
        self._write(walk.select(*KEY, F.posexplode("names").alias("depth", "ancestor")).withColumn("depth", F.col("depth") + 1), folder, "below", "ancestor")
        parents = facts.filter(F.col("parent_session_id").isNotNull()).select(*KEY[:2], F.col("parent_session_id").alias("session_id")).distinct()
        classes = lineage.judged(self._open("seen", affected, more=(folder,)), known, facts, self._open("seen", parents, more=(folder,)), self.complete)
        self._write(classes.withColumn("version", F.lit(batch_id).cast("bigint")), folder, "class")
        self.generations.commit(folder)
        if (batch_id + 1) % self.every == 0:
            self.compact()

    def _affected(self, fresh: DataFrame) -> DataFrame:
        """Sessions whose classes may change by what `fresh` declares."""
        before = self._open("said", fresh)
        was = lineage.settled(self._merged(before)).withColumn("there", F.lit(True))
        becomes = lineage.settled(self._merged(before.unionByName(fresh)))
        both = becomes.join(was.toDF(*KEY, "old_parent", "old_conflict", "there"), list(KEY), "left")
        same = F.col("there").isNotNull() & F.col("parent_session_id").eqNullSafe(F.col("old_parent")) & (F.col("relation_conflict") == F.col("old_conflict"))
        changed = both.select(*KEY, (~F.coalesce(same, F.lit(False))).alias("moved"))
        up = changed.select(*KEY[:2], F.col("session_id").alias("ancestor"), "moved")
        under = self._open("below", fresh, "ancestor").join(up, [*KEY[:2], "ancestor"]).filter("depth = 1 OR moved")
        return changed.select(*KEY).unionByName(under.select(*KEY)).distinct()

    def _placed(self, affected: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(relations, facts, paths): of affected sessions, with the relations of their ancestors.

        The ancestors of a session that is not affected are those of its stored path.
        """
        own = lineage.settled(self._merged(self._open("said", affected, more=(folder,))))
        parents = own.filter(F.col("parent_session_id").isNotNull()).select(*KEY[:2], F.col("parent_session_id").alias("session_id")).distinct()
        steady = materialize(parents.join(affected, list(KEY), "left_anti"))
        stored = self._open("path", steady).groupBy(*KEY).agg(F.max_by("names", "version").alias("names"))
        higher = stored.select(*KEY[:2], F.explode("names").alias("session_id"))
        # a stored path may lead back to an affected session, whose relation is known already
        needed = materialize(steady.unionByName(higher).distinct().join(affected, list(KEY), "left_anti"))
        known = materialize(own.unionByName(lineage.settled(self._merged(self._open("said", needed, more=(folder,))))))
        walk = materialize(lineage.paths(known).join(affected, list(KEY), "left_semi"))
        facts = known.join(affected, list(KEY), "left_semi").join(lineage.chain_facts(walk), list(KEY), "left")
        named = walk.select(*KEY, F.transform(F.slice("path", 1, DEPTH + 1), lambda p: p["name"]).alias("names"))
        return known, facts, affected.join(named, list(KEY), "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))

    def _newest(self) -> DataFrame:
        return self._open("path").groupBy(*KEY).agg(F.max("version").alias("version"))

    def current(self) -> DataFrame:
        """Each observation with the class that all batches so far give it."""
        return self._open("class").join(self._newest(), [*KEY, "version"]).drop("version")

    def compact(self) -> None:
        """Write a base of all that is whole, and remove what no reader of this or the last base needs."""
        last = self.generations.active()
        folder = f"base-{last}"
        paths = self._open("path").join(self._newest(), [*KEY, "version"])
        self._write(self._open("seen"), folder, "seen")
        self._write(self._merged(self._open("said")), folder, "said")
        self._write(paths, folder, "path")
        self._write(paths.select(*KEY, F.posexplode("names").alias("depth", "ancestor")).withColumn("depth", F.col("depth") + 1), folder, "below", "ancestor")
        self._write(self._open("class").join(self._newest(), [*KEY, "version"]), folder, "class")
        self.generations.commit(folder)
        self.generations.prune()


def maintain(observations: DataFrame, store: ReplayStore, checkpoint: str):
    """Start the query over a stream of observations; availableNow works off what there is and ends."""
    return observations.writeStream.foreachBatch(lambda rows, n: store.apply(rows, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
