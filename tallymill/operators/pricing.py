"""Rates, cost of price-basis rows, and what a target costs, rounded once."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.operators.rollup import PRICE_KEYS

ROWS = 512
#: The sums by which price-basis rows are ranked, in this order.
PRICE_SUMS_BY_WEIGHT = ("event_count", "calculable_events", "reported_events", "uncached", "cached", "billable", "reported_cost")
#: Micro-dollars a million uncached, cached and output tokens, short then long context; priority likewise.
RATES = (
    ("gpt-5.6-sol", ("gpt-5.6",), (5_000_000, 500_000, 30_000_000), (10_000_000, 1_000_000, 45_000_000), (10_000_000, 1_000_000, 60_000_000), None),
    ("gpt-5.6-terra", (), (2_500_000, 250_000, 15_000_000), (5_000_000, 500_000, 22_500_000), (5_000_000, 500_000, 30_000_000), None),
    ("gpt-5.6-luna", (), (1_000_000, 100_000, 6_000_000), (2_000_000, 200_000, 9_000_000), (2_000_000, 200_000, 12_000_000), None),
    ("gpt-5.5", ("gpt-5.5-2026-04-23",), (5_000_000, 500_000, 30_000_000), (10_000_000, 1_000_000, 45_000_000), (12_500_000, 1_250_000, 75_000_000), None),
    ("gpt-5.5-pro", ("gpt-5.5-pro-2026-04-23",), (30_000_000, 30_000_000, 180_000_000), None, None, None),
    ("gpt-5.4", ("gpt-5.4-2026-03-05",), (2_500_000, 250_000, 15_000_000), (5_000_000, 500_000, 22_500_000), (5_000_000, 500_000, 30_000_000), None),
    ("gpt-5.4-pro", ("gpt-5.4-pro-2026-03-05",), (30_000_000, 30_000_000, 180_000_000), (60_000_000, 60_000_000, 270_000_000), None, None),
    ("gpt-5.4-mini", ("gpt-5.4-mini-2026-03-17",), (750_000, 75_000, 4_500_000), None, (1_500_000, 150_000, 9_000_000), None),
    ("gpt-5.4-nano", ("gpt-5.4-nano-2026-03-17",), (200_000, 20_000, 1_250_000), None, None, None),
    ("gpt-5.3-codex", (), (1_750_000, 175_000, 14_000_000), None, None, None),
    ("gpt-5.2", ("gpt-5.2-2025-12-11", "gpt-5.2-codex"), (1_750_000, 175_000, 14_000_000), None, (3_500_000, 350_000, 28_000_000), None),
    ("gpt-5.1", ("gpt-5.1-codex", "gpt-5.1-codex-max"), (1_250_000, 125_000, 10_000_000), None, (2_500_000, 250_000, 20_000_000), None),
    ("gpt-5", ("gpt-5-2025-08-07", "gpt-5-codex"), (1_250_000, 125_000, 10_000_000), None, (2_500_000, 250_000, 20_000_000), None),
    ("gpt-5-mini", ("gpt-5-mini-2025-08-07",), (250_000, 25_000, 2_000_000), None, (450_000, 45_000, 3_600_000), None),
    ("gpt-5-nano", ("gpt-5-nano-2025-08-07",), (50_000, 5_000, 400_000), None, None, None),
)
_RATE = "decimal(13,0)"


def rate_rows() -> list[tuple]:
    """(name, canonical, tier class, context, three rates), a row for each name and supported combination."""
    out = []
    for model, aliases, *combos in RATES:
        for (tier, context), r in zip((("standard", "short"), ("standard", "long"), ("priority", "short"), ("priority", "long")), combos, strict=True):
            out += [(name, model, tier, context, *r) for name in (model, *aliases) if r]
    return out


def catalogue(spark: SparkSession, overrides: list[tuple] = ()) -> DataFrame:
    """Rates by name, tier class and context. An override row (same columns, null rates kept) patches single rates."""
    names = "name string, canonical string, tier_class string, context string, uncached_rate long, cached_rate long, output_rate long"
    base = spark.createDataFrame(rate_rows(), names)
    if not overrides:
        return base
    if len(overrides) > ROWS or len({tuple(o[i] for i in (0, 2, 3)) for o in overrides}) != len(overrides):
        raise ValueError("overrides are at most 512 and do not conflict")
    keys = ["name", "tier_class", "context"]
    new = spark.createDataFrame(list(overrides), names).select(*keys, F.col("canonical").alias("n0"), *[F.col(c).alias(f"n{k}") for k, c in enumerate(("uncached_rate", "cached_rate", "output_rate"), 1)])
    joined = base.join(new, keys, "full")
    return joined.select("name", F.coalesce("n0", "canonical").alias("canonical"), "tier_class", "context", *[F.coalesce(f"n{k}", c).alias(c) for k, c in enumerate(("uncached_rate", "cached_rate", "output_rate"), 1)])


def parse_rate(text: Column) -> Column:
    """Micro-dollars of a rate in dollars: digits, at most six after a point, at most a million dollars; else null."""
    micros = F.when(text.rlike(r"^[0-9]{1,12}(\.[0-9]{1,6})?$"), (text.cast("decimal(20,6)") * 1_000_000).cast("bigint"))
    return F.when(micros <= 10**12, micros)


def snapshot(models: dict[str, dict[tuple[str, str], tuple]], aliases: dict[str, str]) -> tuple[list[tuple], str]:
    """(override rows for `catalogue`, revision) of price overrides, all or none.

    models: by model, the three rates (None keeps the built-in one) of each (tier class, context). aliases: name to
    target, which is a model of its own, built in or given here. At most 512 entries; an alias may be no built-in name
    and point to no other alias; a new model needs whole standard rates of short context.
    """
    built, names = {r[1] for r in rate_rows()}, {r[0] for r in rate_rows()}
    valid = lambda x: x and len(x) <= 128 and all(c.isascii() and (c.isalnum() or c in "._:/+-") for c in x)
    if len(models) + len(aliases) > ROWS or models.keys() & aliases.keys() or not all(map(valid, (*models, *aliases, *aliases.values()))):
        raise ValueError("overrides are at most 512, valid and named once")
    if (models.keys() & (names - built)) or (aliases.keys() & names):
        raise ValueError("an override may not take a built-in alias, an alias no built-in name")
    if any(t in aliases or t in names - built for t in aliases.values()):
        raise ValueError("an alias points to a model, not to an alias")
    if any(t not in built and t not in models for t in aliases.values()):
        raise ValueError("an alias points to no known model")
    base = {(r[0], r[2], r[3]): r[4:] for r in rate_rows()}
    merged = dict(base)
    for model, rates in models.items():
        if not any(x is not None for r in rates.values() for x in r):
            raise ValueError("an override changes a rate")
        for (tier, context), r in rates.items():
            old = base.get((model, tier, context), (None, None, None))
            merged[model, tier, context] = tuple(o if n is None else n for o, n in zip(old, r, strict=True))
        if any(None in merged[model, *k] for k in rates) or (model, "standard", "short") not in merged:
            raise ValueError("a rule has all three rates")
    rows = [(m, m, *k, *merged[m, *k]) for m in sorted(models) for k in sorted(models[m])]
    # built-in aliases of a changed model follow it
    rows += [(n, c, *k, *merged[c, *k]) for n, c in sorted({r[:2] for r in rate_rows()}) if n != c and c in models for k in sorted(models[c])]
    rows += [(a, t, *k[1:], *r) for a, t in sorted(aliases.items()) for k, r in sorted(merged.items()) if k[0] == t]
    return rows, hashlib.sha256(repr((sorted((m, sorted(v.items())) for m, v in models.items()), sorted(aliases.items()))).encode()).hexdigest()


def rank() -> list[Column]:
    """The order in which price-basis rows are shown: those of most events first, then by the other sums, then by key."""
    return [*map(F.desc, PRICE_SUMS_BY_WEIGHT), *map(F.col, PRICE_KEYS)]


def page(rows: DataFrame, limit: int = ROWS) -> DataFrame:
    """The first price-basis rows by rank, with the events of all rows and of those that the page omits."""
    every = rows.agg(F.coalesce(F.sum("event_count"), F.lit(0)).cast("bigint").alias("all_events"))
    kept = rows.orderBy(*rank()).limit(limit)
    shown = kept.agg(F.coalesce(F.sum("event_count"), F.lit(0)).cast("bigint").alias("shown"))
    return kept.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(shown)).withColumn("omitted_events", F.col("all_events") - F.col("shown")).drop("shown")


def incoherent(rows: DataFrame) -> DataFrame:
    """Price-basis rows that cannot be: no events, more calculable than all, or costs told for some events only."""
    none = (F.col("reported_events") == 0) & F.col("reported_cost").isNull()
    every = F.col("reported_cost").isNotNull() & (F.col("reported_events") == F.col("event_count"))
    return rows.filter((F.col("event_count") <= 0) | (F.col("calculable_events") > F.col("event_count")) | ~(none | every))


def unaccounted(rows: DataFrame, expected: DataFrame, *target: str) -> DataFrame:
    """Targets whose price-basis rows do not hold as many events as their metrics (`event_count`) say."""
    got = rows.groupBy(*target).agg(F.sum("event_count").cast("bigint").alias("priced_events"))
    both = expected.select(*target, F.col("event_count").alias("metric_events")).join(got, list(target), "full").fillna(0, ["priced_events", "metric_events"])
    return both.filter(F.col("priced_events") != F.col("metric_events"))


def _half_up(numerator: Column) -> Column:
    return F.floor((numerator + 500_000) / F.lit(1_000_000)).cast("bigint")


def priced(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Price-basis rows with the numerator of their calculated cost (micro-dollars times a million) or why there is none.

    The catalogue has 15 models and at most 512 overrides, so it is broadcast.
    """
    tier = F.when(F.col("tier") == "priority", "priority").when(F.col("tier") != "unknown", "standard")
    names = rates.select("name").distinct().withColumn("known", F.lit(True))
    at = rates.withColumnRenamed("name", "model")
    out = rows.withColumn("tier_class", tier).join(F.broadcast(names.withColumnRenamed("name", "model")), "model", "left").join(F.broadcast(at), ["model", "tier_class", "context"], "left")
    numerator = sum((F.col(t).cast("decimal(20,0)") * F.col(r).cast(_RATE) for t, r in (("cached", "cached_rate"), ("billable", "output_rate"))), F.col("uncached").cast("decimal(20,0)") * F.col("uncached_rate").cast(_RATE))
    reason = (
        F.when(F.col("calculable_events") == 0, "token_basis_unavailable")
        .when(F.col("known").isNull(), "model_unpriced")
        .when(F.col("tier") == "unknown", "tier_unknown")
        .when(F.col("context") == "unavailable", "context_unavailable")
        .when(F.col("uncached_rate").isNull(), "tier_context_unsupported")
    )
    return out.withColumn("reason", reason).withColumn("numerator", F.when(F.col("reason").isNull(), numerator.cast("decimal(38,0)")))


def conflict(reported: Column, calculated: Column) -> Column:
    """Apart by more than a cent and more than two in a hundred of the larger."""
    apart = F.abs(reported - calculated)
    return (apart > 10_000) & (apart * 100 > F.greatest(reported, calculated) * 2)


def select_cost(rows: DataFrame, rates: DataFrame, *target: str, mode: str = "auto") -> DataFrame:
    """What each target costs: the amount, event counters, availability, composition and missing reasons.

    auto takes a reported cost where there is one, calculated takes none, reported takes nothing else.
    """
    p = priced(rows, rates)
    reported = F.col("reported_cost").isNotNull()
    take = {"auto": reported, "calculated": F.lit(False), "reported": F.lit(True)}[mode]
    paid, by_rate = take & reported, ~take & F.col("numerator").isNotNull()
    chosen = F.when(paid, F.col("reported_cost").cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(8,0)")).when(by_rate, F.col("numerator"))
    rounded = _half_up(F.col("numerator"))
    clash = (F.col("reported_events") == F.col("event_count")) & (F.col("calculable_events") == F.col("event_count")) & conflict(F.col("reported_cost"), rounded)
    partly = by_rate & (F.col("calculable_events") < F.col("event_count"))
    why = F.when(take & ~reported, "reported_cost_missing").when(~take & F.col("reason").isNotNull(), F.col("reason")).when(partly, "token_basis_unavailable")
    none = F.lit(0)
    total = lambda c: F.coalesce(F.sum(c), none).cast("bigint")
    got = p.groupBy(*target).agg(
        F.sum(chosen.cast("decimal(38,0)")).alias("numerator"),
        total("event_count").alias("total_events"),
        total(F.when(by_rate, F.col("calculable_events")).otherwise(none)).alias("priced_events"),
        total(F.when(paid, F.col("reported_events")).otherwise(none)).alias("reported_events"),
        total(F.when(by_rate & (F.col("tier") == "standard_assumed"), F.col("calculable_events")).otherwise(none)).alias("assumed_events"),
        total(F.when(paid, none).when(by_rate, F.col("event_count") - F.col("calculable_events")).otherwise(F.col("event_count"))).alias("unpriced_events"),
        total(F.when(clash, F.col("event_count")).otherwise(none)).alias("conflict_events"),
        F.slice(F.sort_array(F.collect_set(F.when(why.isNotNull(), F.concat_ws(":", why, "model")))), 1, 32).alias("missing"),
    )
    picked = F.col("priced_events") + F.col("reported_events")
    amount = F.when((picked > 0) | (F.col("total_events") == 0), F.coalesce(_half_up(F.col("numerator")), none.cast("bigint")))
    whole = F.when(F.col("amount") == 0, "zero").otherwise("complete")
    available = F.when(F.col("total_events") == 0, "zero").when(picked == 0, "unavailable").when(F.col("unpriced_events") == 0, whole).otherwise("partial")
    mixed = F.when((F.col("priced_events") > 0) & (F.col("reported_events") > 0), "mixed").when(F.col("priced_events") > 0, "calculated").when(F.col("reported_events") > 0, "reported").otherwise("none")
    return got.withColumn("amount", amount).withColumn("availability", available).withColumn("composition", mixed).withColumn("missing", F.array_join("missing", ",")).drop("numerator")


def batch(rows: DataFrame, *target: str, limit: int = ROWS) -> DataFrame:
    """At most `limit` rows over all targets, each target's first row by rank before any second one; with what was left out.

    Ranks come from a rank-only window, which keeps a limit for each group; totals are a grouping of their own.
    """
    keys = Window.partitionBy(*target).orderBy(*rank())
    kept = rows.withColumn("key_rank", F.row_number().over(keys)).filter(F.col("key_rank") <= limit).orderBy("key_rank", *target).limit(limit)
    totals = rows.groupBy(*target).agg(F.sum("event_count").cast("bigint").alias("target_events"))
    shown = kept.groupBy(*target).agg(F.sum("event_count").cast("bigint").alias("shown_events"), F.count("*").alias("keys"))
    return totals.join(shown, list(target), "left").fillna(0).withColumn("omitted_events", F.col("target_events") - F.col("shown_events"))
