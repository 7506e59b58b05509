"""Rate-limit windows as time series: duplicates and stale samples out, resets, allowance changes, epochs, maxima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.checkpoints import stored
from tallymill.functions.stretches import STRETCH, along, met

KEY = ("scope_id", "window_id")
#: Milliseconds of a window that are one stretch of it.
STRETCH_MS = 3_600_000
#: What a sample is judged by of the accepted one before it.
SAMPLE = ("observation_id", "used_ppm", "remaining_ppm", "unit_id", "used_units", "capacity_units", "advertised_resets_at_ms", "observed_at_ms", "provider_epoch_id")
#: Where an epoch stands: its number, the transitions so far, its first observation.
BASE = ("base_epoch", "base_sequence", "base_first")
#: Thresholds of a fixed window in parts per million: used at most, remaining at least, drop at least.
THRESHOLDS = (100_000, 900_000, 300_000)


def accepted(samples: DataFrame) -> DataFrame:
    """Samples later than all before them; of several at one moment the smallest observation id counts."""
    first = samples.groupBy(*KEY, "observed_at_ms").agg(F.min(F.struct("observation_id", *[c for c in samples.columns if c not in (*KEY, "observed_at_ms", "observation_id")])).alias("m"))
    return first.select(*KEY, "observed_at_ms", "m.*")


def _id(kind: str, *fields: Column) -> Column:
    """Identity of an epoch or a transition from its fields, each as text behind its length."""
    return F.sha2(F.concat_ws("|", F.lit(f"tallymill.quota.{kind}"), *[F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]), 256)


def epoch_id(first: Column) -> Column:
    """The id of the epoch that begins with an observation of the row's window."""
    return _id("epoch", *map(F.col, KEY), first)


def transition_id() -> Column:
    return _id("transition", *map(F.col, KEY), F.col("sequence"), F.coalesce("reset_kind", F.lit("allowance_changed")), F.col("previous_epoch_id"), F.col("epoch_id"), F.col("pre_observation_id"), F.col("observation_id"))


def in_stretches(rows: DataFrame) -> DataFrame:
    """Rows with the stretch of their window that they stand in."""
    return rows.withColumn(STRETCH, F.floor(F.col("observed_at_ms") / STRETCH_MS).cast("bigint"))


def transitions(samples: DataFrame, thresholds: tuple[int | None, int | None, int | None] = THRESHOLDS) -> DataFrame:
    """Accepted samples with signal, reset kind, allowance change, epoch, sequence, ids, confidence and detection time.

    A reset is told by hand, by another epoch of the provider, explicitly, or by thresholds: those count in fixed windows
    for samples of sure quality and confidence; a threshold that is not set passes, a value that is not known fails it.
    What a sample means depends on the accepted one before it alone, so a lag stands for the state; a window is followed
    stretch by stretch.
    """
    rows = judged(samples, thresholds).drop(*BASE, "epoch_first")
    within = Window.partitionBy(*KEY, "epoch").orderBy("observed_at_ms").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("max_used_ppm", F.max("used_ppm").over(within))


def judged(samples: DataFrame, thresholds: tuple[int | None, int | None, int | None] = THRESHOLDS, state: DataFrame | None = None) -> DataFrame:
    """Transitions without maxima, with `epoch_first`. `state` has the last accepted sample of each window (SAMPLE and BASE):
    what is not later is left out, and the row of the state is told again, with BASE set.
    """
    rows = accepted(samples)
    if state is not None:
        rows = met(rows, state.select(*KEY, F.col("observed_at_ms").alias("upto")), KEY, "observed_at_ms", "left").filter(F.col("upto").isNull() | (F.col("observed_at_ms") > F.col("upto"))).drop("upto")
    rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in BASE})
    if state is not None:
        rows = rows.unionByName(state.select(*KEY, *SAMPLE, *BASE), allowMissingColumns=True)
    rows = along(stored(in_stretches(rows)), KEY, "observed_at_ms", {"p": ("last_before", F.struct(*SAMPLE))})
    rows = rows.withColumns({f"p_{n}": F.col("p")[n] for n in SAMPLE}).drop("p")
    has, now, was = F.col("p_observed_at_ms").isNotNull(), F.col("observed_at_ms"), F.col("p_observed_at_ms")
    known = lambda c: F.coalesce(c, F.lit(False))
    most, least, drop = thresholds
    used, before = F.col("used_ppm"), F.col("p_used_ppm")
    recovered = known(used < before) | known(F.col("remaining_ppm") > F.col("p_remaining_ppm"))
    fell = recovered
    for bound, passes in ((most, lambda x: used <= x), (least, lambda x: F.col("remaining_ppm") >= x), (drop, lambda x: before - used >= x)):
        fell = fell if bound is None else fell & known(passes(bound))
    sure = (F.col("semantics") == "fixed") & ~F.col("quality").isin("conflict", "unknown") & ~F.col("confidence").isin("low", "unknown")
    boundary, told = F.col("p_advertised_resets_at_ms"), F.col("advertised_resets_at_ms")
    evidence = F.col("reset_evidence")
    signal = (
        F.when(~has, None)
        .when(evidence == "manual_or_banked", "manual")
        .when(F.col("provider_epoch_id") != F.col("p_provider_epoch_id"), "provider_epoch")
        .when(evidence.isin("explicit_provider", "explicit_local"), "explicit")
        .when(sure & fell & (told > boundary), "threshold_advanced")
        .when(sure & fell & (told.isNull() | boundary.isNull()), "threshold_unknown")
    )
    exact = F.when(F.col("reset_occurred_at_ms") > was, F.col("reset_occurred_at_ms"))
    kind = F.when(signal.isNull(), None).when(signal == "manual", "manual_or_banked").when((signal == "threshold_unknown") | boundary.isNull(), "unknown").when(F.coalesce(exact, now) >= boundary, "scheduled").otherwise("early")
    more, less = F.col("capacity_units") > F.col("p_capacity_units"), F.col("capacity_units") < F.col("p_capacity_units")
    both = F.col("capacity_units").isNotNull() & F.col("p_capacity_units").isNotNull()
    allowance = F.when(both & (F.col("unit_id") != F.col("p_unit_id")), "unit_changed").when(more, "increased").when(less, "decreased")
    doubtful = (signal == "threshold_unknown") | ((signal == "threshold_advanced") & (F.col("quality") == "partial"))
    rows = rows.withColumns({"signal": signal, "reset_kind": kind, "allowance_change": allowance})
    changed, resets = F.col("reset_kind").isNotNull() | F.col("allowance_change").isNotNull(), F.col("reset_kind").isNotNull()
    rows = rows.withColumns({
        "transition_confidence": F.when(changed, F.when(known(doubtful), "low").otherwise(F.col("confidence"))),
        "occurred_at_ms": F.when(resets, exact), "after_ms": F.when(changed & ~(resets & exact.isNotNull()), was), "at_or_before_ms": F.when(changed & ~(resets & exact.isNotNull()), now),
    })
    begun = F.coalesce("base_first", F.when(resets | ~has, F.col("observation_id")))
    rows = along(rows, KEY, "observed_at_ms", {
        "epoch": ("sum", resets.cast("bigint") + F.coalesce("base_epoch", F.lit(0))), "sequence": ("sum", changed.cast("bigint") + F.coalesce("base_sequence", F.lit(0))),
        "epoch_first": ("last", begun), "previous_first": ("last_before", begun),
    })
    rows = rows.withColumns({"epoch_id": epoch_id(F.col("epoch_first")), "previous_epoch_id": F.when(has, epoch_id(F.col("previous_first")))})
    rows = rows.withColumnRenamed("p_observation_id", "pre_observation_id")
    rows = rows.withColumn("transition_id", F.when(changed, transition_id()))
    return rows.drop(STRETCH, "previous_first", *[f"p_{n}" for n in SAMPLE])


def sequence_gaps(changes: DataFrame) -> DataFrame:
    """(scope_id, window_id, transitions, last, gaps): each transition's sequence is the one before and one more; gaps are those that are missing."""
    moved = F.col("transition_id").isNotNull()
    per = changes.groupBy(*KEY).agg(F.count_if(moved).alias("transitions"), F.max("sequence").alias("last"), F.count_distinct(F.when(moved, F.col("sequence"))).alias("known"))
    return per.select(*KEY, "transitions", "last", (F.col("last") - F.col("known")).alias("gaps"))


def current_windows(changes: DataFrame) -> DataFrame:
    """The newest state of each window."""
    columns = ("observed_at_ms", "epoch", "sequence", "used_ppm", "max_used_ppm", "observation_id", "epoch_id", "fresh_until_ms", "stale_after_ms", "quality")
    latest = changes.groupBy(*KEY).agg(F.max(F.struct(*columns)).alias("m"))
    return latest.select(*KEY, "m.*")


def requested(current: DataFrame, filters: list[tuple[str, str]], now_ms: int) -> DataFrame:
    """The windows asked for, in that order (at most 256), with freshness and quality; a missing one is unavailable and unknown."""
    if len(filters) > 256:
        raise ValueError("at most 256 windows")
    asked = current.sparkSession.createDataFrame([(k, *f) for k, f in enumerate(filters)], "place int, scope_id string, window_id string")
    got = asked.join(current, list(KEY), "left")
    return got.withColumns({"freshness": sample_freshness(F.lit(now_ms)), "quality": F.coalesce("quality", F.lit("unknown"))}).orderBy("place")


def sample_freshness(now_ms: Column) -> Column:
    """fresh, aging or stale by a sample's own limits; unavailable where there is none or it lies in the future."""
    at = F.col("observed_at_ms")
    return F.when(at.isNull() | (now_ms < at), "unavailable").when(now_ms <= F.col("fresh_until_ms"), "fresh").when(now_ms <= F.col("stale_after_ms"), "aging").otherwise("stale")


def transition_page(changes: DataFrame, scope: str, window: str, size: int = 256, before: tuple[int, str] | None = None) -> DataFrame:
    """Transitions of a window, newest first, with the samples before and after; `before` is the key of the last row of the page before."""
    pre = changes.select(*KEY, F.col("observation_id").alias("pre_observation_id"), F.col("used_ppm").alias("pre_used_ppm"), F.col("observed_at_ms").alias("pre_observed_at_ms"))
    of = (F.col("scope_id") == scope) & (F.col("window_id") == window)
    rows = changes.filter(of & F.col("transition_id").isNotNull())
    if before is not None:
        rows = rows.filter(F.struct("sequence", "transition_id") < F.struct(F.lit(before[0]).cast("bigint").alias("sequence"), F.lit(before[1]).alias("transition_id")))
    page = rows.orderBy(F.desc("sequence"), F.desc("transition_id")).limit(min(size, 256))
    return page.join(pre.filter(of), [*KEY, "pre_observation_id"], "left").orderBy(F.desc("sequence"), F.desc("transition_id"))


def referenced(changes: DataFrame) -> DataFrame:
    """(scope_id, window_id, observation_id) that a current window, an epoch or a transition still names."""
    changes = stored(changes)
    ends = changes.groupBy(*KEY, "epoch").agg(F.min_by("observation_id", "observed_at_ms").alias("a"), F.max_by("observation_id", "observed_at_ms").alias("z"))
    best = stored(in_stretches(maxima(changes)))
    top = best.groupBy(*KEY, "epoch").agg(F.max_by("max_ppm_observation", "observed_at_ms").alias("r"), F.max_by("max_units_observation", "observed_at_ms").alias("u"))
    moved = changes.filter(F.col("transition_id").isNotNull())
    was = along(best, KEY, "observed_at_ms", {"was": ("last_before", F.struct(F.col("max_ppm_observation").alias("r"), F.col("max_units_observation").alias("u")))})
    before = was.select(*KEY, "observed_at_ms", "was.*").join(moved.select(*KEY, "observed_at_ms"), [*KEY, "observed_at_ms"], "left_semi")
    name = lambda d, *cols: d.select(*KEY, F.explode(F.array(*map(F.col, cols))).alias("observation_id"))
    return name(ends, "a", "z").unionByName(name(top, "r", "u")).unionByName(name(moved, "pre_observation_id", "observation_id")).unionByName(name(before, "r", "u")).filter("observation_id IS NOT NULL").distinct()


def redundant(samples: DataFrame, named: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Samples that a newer one of the same window repeats in every value and that nothing names; the oldest first."""
    same = [c for c in samples.columns if c not in (*KEY, "observation_id", "observed_at_ms", "fresh_until_ms", "stale_after_ms")]
    repeated = (*KEY, *same)
    newest = samples.groupBy(*repeated).agg(F.max(F.struct("observed_at_ms", "observation_id")).alias("newest")).toDF(*[f"n_{c}" for c in repeated], "newest")
    alike = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in repeated))
    older = samples.join(newest, alike).filter(F.struct("observed_at_ms", "observation_id") < F.col("newest"))
    if named is not None:
        older = older.join(named, [*KEY, "observation_id"], "left_anti")
    out = older.select(*KEY, "observation_id", "observed_at_ms").orderBy("observed_at_ms", "observation_id")
    return out if limit is None else out.limit(limit)


def maxima(rows: DataFrame) -> DataFrame:
    """Running maxima of an epoch and the observation that first reached each (columns epoch, used_ppm, unit_id, used_units).

    A sample in another unit clears the maximum of units, and the next one starts anew; samples without units change
    nothing. After a run of two samples or more in a unit there is a maximum; single ones set and clear it by turns.
    """
    return with_maxima(rows).select(*KEY, "observed_at_ms", "epoch", "max_ppm", "max_ppm_observation", "max_units", "max_units_observation", "max_unit_id")


def with_maxima(rows: DataFrame) -> DataFrame:
    """Rows with the running maxima of their epoch."""
    measured = F.col("unit_id").isNotNull() & F.col("used_units").isNotNull()
    rows = rows.withColumn("measured", measured)
    upto = (Window.unboundedPreceding, 0)
    epoch = Window.partitionBy(*KEY, "epoch").orderBy("observed_at_ms")
    seen = Window.partitionBy(*KEY, "epoch", "measured").orderBy("observed_at_ms")
    rows = rows.withColumn("run", F.sum(F.when(F.col("unit_id").eqNullSafe(F.lag("unit_id").over(seen)), 0).otherwise(1)).over(seen.rowsBetween(*upto)))
    run = Window.partitionBy(*KEY, "epoch", "measured", "run")
    along = run.orderBy("observed_at_ms")
    rows = rows.withColumns({"size": F.count("*").over(run), "at": F.row_number().over(along)})
    sure = F.when((F.col("at") == 1) & ((F.col("run") == 1) | (F.col("size") > 1)), F.col("run"))
    rows = rows.withColumn("anchor", F.max(sure).over(seen.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("clears", (F.col("at") == 1) & (F.col("run") > 1) & ((F.col("run") - 1 - F.col("anchor")) % 2 == 0))
    rows = rows.withColumns({"own_ppm": F.col("used_ppm"), "own_units": F.when(F.col("measured") & ~F.col("clears"), F.col("used_units"))})
    for name, over in (("ppm", epoch), ("units", along)):
        before = F.max(f"own_{name}").over(over.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("higher", F.when(F.col(f"own_{name}").isNotNull() & (before.isNull() | (F.col(f"own_{name}") > before)), F.col("observation_id")))
        rows = rows.withColumns({f"max_{name}": F.max(f"own_{name}").over(over.rowsBetween(*upto)), f"max_{name}_observation": F.last("higher", True).over(over.rowsBetween(*upto))})
    state = F.last(F.when(F.col("measured"), F.struct("max_units", "max_units_observation", F.when(F.col("max_units").isNotNull(), F.col("unit_id")).alias("max_unit_id"))), True).over(epoch.rowsBetween(*upto))
    return rows.withColumn("state", state).drop("max_units", "max_units_observation", "measured", "run", "size", "at", "anchor", "clears", "own_ppm", "own_units", "higher").select("*", "state.*").drop("state")
