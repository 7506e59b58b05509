"""Measures of usage rows: the metric vector, availability, price basis, shares and freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.identity import COUNTS

ACTIVITIES = ("read", "edit_write", "search", "git", "build_test", "web", "subagents", "terminal")

METRICS = ("event_count", "fallback_events", *(f"{s}_{c}" for c in COUNTS for s in ("known", "sum")), "long_yes", "long_no", "long_unavailable", *(f"activity_{a}" for a in ACTIVITIES))


def metric_aggregates() -> list[Column]:
    """The 23 metrics of a group of events."""
    out = [F.count("*").alias("event_count"), F.sum("fallback_model").alias("fallback_events")]
    for c in COUNTS:
        out += [F.count(c).alias(f"known_{c}"), F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"sum_{c}")]
    out += [F.count_if(F.col("long_context") == v).alias(f"long_{v}") for v in ("yes", "no", "unavailable")]
    return out + [F.sum(f"activity_{a}").alias(f"activity_{a}") for a in ACTIVITIES]


def merged_metrics() -> list[Column]:
    """Metrics of a union of groups; none gives zeros."""
    return [F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in METRICS]


def availability(count: str) -> Column:
    """known, partial or unavailable, from how many events know the count; no events count as a known zero."""
    known, events = F.col(f"known_{count}"), F.col("event_count")
    return F.when((events == 0) | (known == events), "known").when(known == 0, "unavailable").otherwise("partial")


def price_tier(tier: Column) -> Column:
    low = F.lower(tier)
    return F.when(tier.isNull(), "standard_assumed").when(low.isin("standard", "default"), "standard_reported").when(low.isin("priority", "fast"), "priority").otherwise("unknown")


def calculable() -> Column:
    i, c, o, r, t = map(F.col, COUNTS)
    coherent = (t >= i) & (o.isNull() | r.isNull() | ((o <= t - i) & (r == t - i - o)))
    return F.coalesce(i.isNotNull() & c.isNotNull() & (c <= i) & F.when(t.isNotNull(), coherent).otherwise(o.isNotNull() & r.isNotNull()), F.lit(False))


def price_basis() -> dict[str, Column]:
    """Uncached, cached and billable output tokens of a calculable event, else zeros."""
    i, c, o, r, t = map(F.col, COUNTS)
    on = calculable()
    return {"uncached": F.when(on, i - c).otherwise(0), "cached": F.when(on, c).otherwise(0), "billable": F.when(on, F.coalesce(t - i, o + r)).otherwise(0)}


def share_ppm(part: Column, whole: Column) -> Column:
    """Parts per million, rounded down; null where there is no whole."""
    return F.when(whole > 0, F.floor(part.cast("decimal(30,0)") * 1_000_000 / whole)).cast("bigint")


def elapsed_ppm(start_ms: Column, end_ms: Column, now_ms: Column) -> Column:
    return F.when(end_ms > start_ms, F.least(F.greatest(share_ppm(now_ms - start_ms, end_ms - start_ms), F.lit(0)), F.lit(1_000_000)))


def freshness(age_seconds: Column) -> Column:
    """fresh to 20 minutes, aging to 2 hours, then stale; unknown or future ages are unavailable."""
    return F.when(age_seconds.isNull() | (age_seconds < 0), "unavailable").when(age_seconds <= 1200, "fresh").when(age_seconds <= 7200, "aging").otherwise("stale")
