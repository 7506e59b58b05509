"""Replayed sessions: ancestors, classification of each observation against its parent, and the canonical pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.checkpoints import materialize

DEPTH, CHILDREN = 32, 256
#: Rows of a session from which it is folded by blocks, and rows of a block on average.
HOT, BLOCK = 4_000_000, 1_000_000
#: What a session is known by.
KEY = ("provider_id", "profile_id", "session_id")
#: Order of observations along a session.
ORDER = ("ordinal", "file_key", "generation", "source_offset", "fingerprint")


def canonical(observations: DataFrame, key: str = "fingerprint", order: tuple[str, ...] = ("profile_id", "file_key", "generation", "source_offset")) -> DataFrame:
    """One observation for each key: the smallest in order. A minimum combines before the shuffle, so hot keys do not pile up."""
    rest = [c for c in observations.columns if c != key and c not in order]
    least = observations.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return least.select(key, "m.*").select(*observations.columns)


def relations(observations: DataFrame) -> DataFrame:
    """(key, parent_session_id, relation_conflict) of each session; a session that names two parents has none and a conflict.

    A session is known by provider, profile and name (KEY), and its parent is one of the same provider and profile.
    """
    return settled(declared(observations))


def declared(observations: DataFrame) -> DataFrame:
    """(key, low, high, said, rows): what rows declare of a session; minima, maxima and a count, so parts of it can be merged."""
    return observations.groupBy(*KEY).agg(F.min("parent_session_id").alias("low"), F.max("parent_session_id").alias("high"), F.max("relation_conflict").alias("said"), F.count("*").alias("rows"))


def settled(said: DataFrame) -> DataFrame:
    """The relations that merged declarations amount to."""
    two = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    itself = F.coalesce(F.col("low") == F.col("session_id"), F.lit(False))
    return said.select(*KEY, F.when(~two & ~itself, F.col("low")).alias("parent_session_id"), (F.coalesce("said", F.lit(False)) | two | itself).alias("relation_conflict"))


def paths(relations: DataFrame) -> DataFrame:
    """(key, path): the ancestors of each session that has a parent, nearest first, each with `bad`, whether its own relation is in conflict.

    A path goes no further than an ancestor in conflict, and holds all of the first 33. Each join doubles what is known;
    joins end when no path grows, after six at the latest, so paths stay under 65 names. Two joins share a checkpoint.
    """
    place = list(KEY[:2])
    bad = relations.select(*place, F.col("session_id").alias("parent_session_id"), F.col("relation_conflict").alias("bad"))
    hop = relations.filter(F.col("parent_session_id").isNotNull()).select(*KEY, "parent_session_id").join(bad, [*place, "parent_session_id"], "left")
    walk = hop.select(*KEY, F.array(F.struct(F.col("parent_session_id").alias("name"), F.coalesce("bad", F.lit(False)).alias("bad"))).alias("path"), F.lit(True).alias("grew"))
    walk = materialize(walk)
    for _ in range(3):
        for _ in range(2):
            step = walk.select(*place, F.col("session_id").alias("at"), F.col("path").alias("more"))
            end = F.when(~F.element_at("path", -1)["bad"], F.element_at("path", -1)["name"])
            met = walk.withColumn("at", end).join(step, [*place, "at"], "left")
            walk = met.select(*KEY, F.concat("path", F.coalesce("more", F.filter("path", lambda p: F.lit(False)))).alias("path"), F.col("more").isNotNull().alias("grew"))
        walk = materialize(walk)
        if walk.filter("grew").isEmpty():
            break
    return walk.select(*KEY, "path")


def ancestors(relations: DataFrame) -> DataFrame:
    """(key, depth, cycle, conflict, over): how far each session's chain of parents goes, up to 33.

    A chain that returns is a cycle; it stops at an ancestor whose own relation is in conflict, and is over where it is
    longer than 32.
    """
    return chain_facts(paths(relations))


def chain_facts(walk: DataFrame) -> DataFrame:
    first = F.slice("path", 1, DEPTH + 1)
    names = F.transform(first, lambda p: p["name"])
    bads = F.transform(F.slice("path", 1, DEPTH), lambda p: p["bad"])
    stop = F.array_position(bads, True)
    s = F.col("session_id")
    cycle = F.array_contains(names, s) | (F.size(F.array_distinct(names)) < F.size(names))
    # names differ up to the first that comes back
    back = F.when(F.array_contains(names, s), F.array_position(names, s)).otherwise(F.size(F.array_distinct(names)) + 1)
    depth = F.when(cycle, back).when(stop > 0, stop).otherwise(F.least(F.size("path"), F.lit(DEPTH + 1))).cast("int")
    conflict = (stop > 0) & ~cycle
    return walk.select(*KEY, depth.alias("depth"), cycle.alias("cycle"), conflict.alias("conflict"), ((depth > DEPTH) & ~cycle & ~conflict).alias("over"))


def fan_out(relations: DataFrame) -> DataFrame:
    of_parent = (*KEY[:2], "parent_session_id")
    return relations.filter(F.col("parent_session_id").isNotNull()).groupBy(*of_parent).agg(F.least(F.count("*"), F.lit(CHILDREN + 1)).alias("children"))


def parent_facts(observations: DataFrame) -> DataFrame:
    """(provider_id, profile_id, parent_session_id, ordinal, parent): what a parent says at an ordinal, the first by file, generation, offset and fingerprint."""
    fact = F.struct(*ORDER[1:], "signature", "strong", "declared_conflict", "relation_conflict")
    return observations.groupBy(*KEY[:2], F.col("session_id").alias("parent_session_id"), "ordinal").agg(F.min(fact).alias("parent"))


def classify(observations: DataFrame, complete: bool = True) -> DataFrame:
    """Each observation as eligible, replay, pending or conflict: a child repeats its parent until the first cause to stop.

    A difference, or a gap in the parent under a complete manifest, makes the rest eligible; a gap under an open one
    leaves the rest pending; whichever comes first rules. A declared conflict, of the child or of the parent at its
    ordinal, makes the rest conflict; a conflicting relation, or a cycle, all. Chains over 32 are pending. The fold is a
    running first value along the session. Roots take no part in the join with parents, so no null key gathers them.
    A session of more than HOT rows is folded by blocks, each a task's work, and what a block comes to is carried on.
    """
    said = materialize(declared(observations))
    known = settled(said)
    hot = said.filter(F.col("rows") > HOT).select(*KEY)
    return judged(observations, known, known.join(ancestors(known), list(KEY), "left"), observations, complete, None if hot.isEmpty() else hot)


def _folded(rows: DataFrame, cause: Column, said: Column) -> DataFrame:
    """The rows with the first cause and whether anything was said, so far along their session."""
    along = Window.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"__ruled": F.first(cause, ignorenulls=True).over(along), "__spoiled": F.max(said).over(along)})


def _folded_by_blocks(rows: DataFrame, cause: Column, said: Column) -> DataFrame:
    """The same for few sessions of very many rows: ranges of a session are folded apart, and each takes on what those before it come to."""
    marked = rows.withColumns({"__cause": cause, "__said": said})
    blocks = max(1, -(-rows.count() // BLOCK))
    ranged = materialize(marked.repartitionByRange(blocks, *KEY, *ORDER).withColumn("__block", F.spark_partition_id()))
    at = (*KEY, "__block")
    ends = ranged.groupBy(*at).agg(F.min_by("__cause", F.when(F.col("__cause").isNotNull(), F.struct(*ORDER))).alias("c"), F.max("__said").alias("s"))
    before = Window.partitionBy(*KEY).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carried = ends.select(*at, F.first("c", ignorenulls=True).over(before).alias("__c"), F.max("s").over(before).alias("__s"))
    within = Window.partitionBy(*at).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({"__ruled": F.first("__cause", ignorenulls=True).over(within), "__spoiled": F.max("__said").over(within)}).join(carried, list(at))
    whole = {"__ruled": F.coalesce("__c", "__ruled"), "__spoiled": F.coalesce("__s", F.lit(False)) | F.col("__spoiled")}
    return local.withColumns(whole).select(*rows.columns, "__ruled", "__spoiled")


def judged(observations: DataFrame, relations: DataFrame, facts: DataFrame, of_parents: DataFrame, complete: bool, hot: DataFrame | None = None) -> DataFrame:
    """The observations with `disposition`.

    facts has a row for each of their sessions: relation, cycle, conflict and over; of_parents holds their parents' rows, and
    relations those of the parents; hot names sessions of very many rows.
    """
    named = facts.select(*KEY, F.col("parent_session_id").alias("__parent"), F.col("relation_conflict").alias("__bad"), "cycle", "conflict", "over")
    rows = observations.drop("relation_conflict").join(named, list(KEY))
    child = rows.filter(F.col("__parent").isNotNull())
    up = facts.filter(F.col("parent_session_id").isNotNull()).select(*KEY[:2], F.col("parent_session_id").alias("session_id")).distinct()
    needed = of_parents.drop("relation_conflict").join(up, list(KEY), "left_semi").join(relations.select(*KEY, "relation_conflict"), list(KEY))
    parents = parent_facts(needed)
    met = child.join(parents.withColumnRenamed("parent_session_id", "__parent"), [*KEY[:2], "__parent", "ordinal"], "left")
    alone = rows.filter(F.col("__parent").isNull()).withColumn("parent", F.lit(None).cast(parents.schema["parent"].dataType))
    every = met.unionByName(alone)
    of_child, gone = F.col("__parent").isNotNull(), F.col("parent").isNull()
    both = F.coalesce(F.col("strong") & F.col("parent.strong"), F.lit(False))
    cause = F.when(of_child & gone, "eligible" if complete else "pending").when(of_child & both & (F.col("signature") != F.col("parent.signature")), "eligible")
    said = F.col("declared_conflict") | F.coalesce(F.col("parent.declared_conflict") | F.col("parent.relation_conflict"), F.lit(False))
    folded = _folded(every if hot is None else every.join(hot, list(KEY), "left_anti"), cause, said)
    if hot is not None:
        folded = folded.unionByName(_folded_by_blocks(every.join(hot, list(KEY), "left_semi"), cause, said))
    ruled = F.col("__ruled")
    broken = F.col("__bad") | F.coalesce("cycle", F.lit(False)) | F.coalesce("conflict", F.lit(False)) | F.col("__spoiled")
    disposition = F.when(broken, "conflict").when(F.coalesce("over", F.lit(False)), "pending").when(~of_child, "eligible").when(ruled.isNotNull(), ruled).when(both, "replay").otherwise("pending")
    return folded.withColumn("disposition", disposition).select(*[c for c in observations.columns if c != "relation_conflict"], "disposition")


def selection(classified: DataFrame) -> DataFrame:
    """The canonical pick of each fingerprint among eligible observations."""
    return canonical(classified.filter(F.col("disposition") == "eligible"), order=("profile_id", *ORDER[1:4]))


def replay_quality(classified: DataFrame) -> DataFrame:
    return classified.agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in ("eligible", "replay", "pending", "conflict")])


def materialize_selection(prior: DataFrame, selected: DataFrame, classified: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Selected events, and prior ones kept as retained: those once projected that are not proven replays (a conflict keeps them)."""
    proven = classified.groupBy(key).agg(F.max(F.col("disposition") == "replay").alias("replay"), F.max(F.col("disposition") == "conflict").alias("conflict")).filter("replay AND NOT conflict")
    kept = prior.filter("projected").drop("projected").join(selected.select(key), key, "left_anti").join(proven.select(key), key, "left_anti")
    return selected.withColumn("retained", F.lit(0)).unionByName(kept.withColumn("retained", F.lit(1)))
