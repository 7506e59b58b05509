"""Usage queries over rollups: overview, daily series, breakdowns, rhythm, lifetime, activity and session pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.measures import METRICS, merged_metrics
from tallymill.operators.calendar import rhythm_buckets, segment_buckets

PAGE, ITEMS, TARGETS, DAYS = 256, 256, 401, 400
#: Parts that the events of one source file are spread over where they meet their source.
PARTS = 64


def scoped(frame: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
    """Rows of at most 32 (provider, profile) pairs; none means all. The list is small by its bound, so it is broadcast."""
    if len(scopes) > 32:
        raise ValueError("at most 32 scopes")
    if not scopes:
        return frame
    pairs = frame.sparkSession.createDataFrame(scopes, "provider_id string, profile_id string")
    return frame.join(F.broadcast(pairs), ["provider_id", "profile_id"], "left_semi")


def in_range(rollup: DataFrame, targets: list[tuple[int, int, int]]) -> DataFrame:
    """Rollup rows of each target's buckets; at most 401 targets of at most 400 days, so buckets are broadcast.

    The outer bounds are a plain filter, which reaches the files.
    """
    if len(targets) > TARGETS or any(b - a > DAYS * 86_400 + 86_400 for _, a, b in targets):
        raise ValueError("at most 401 targets of at most 400 days")
    inside = rollup.filter(F.col("bucket_start").between(min((a for _, a, _ in targets), default=0), max((b for _, _, b in targets), default=0)))
    return inside.join(F.broadcast(segment_buckets(rollup.sparkSession, targets)), ["bucket_width", "bucket_start"])


def overview(rollup: DataFrame, start: int, end: int, scopes: list[tuple[str, str]] = ()) -> DataFrame:
    rows = scoped(rollup.filter(F.col("dimension") == "all"), list(scopes))
    return in_range(rows, [(0, start, end)]).agg(*merged_metrics())


def daily_series(rollup: DataFrame, targets: list[tuple[int, int, int]]) -> DataFrame:
    """One row of metrics for each target, zeros where nothing happened."""
    spark = rollup.sparkSession
    found = in_range(rollup.filter(F.col("dimension") == "all"), targets).groupBy("target").agg(*merged_metrics())
    every = spark.createDataFrame([(t,) for t, _, _ in targets], "target long")
    return every.join(found, "target", "left").fillna(0, list(METRICS))


def breakdown(rollup: DataFrame, start: int, end: int, kind: str, limit: int = ITEMS) -> DataFrame:
    """Metrics by model, project, provider or profile; most tokens first, at most `limit` rows (`full_analytics` tells whether more follow)."""
    keys = {"model": ["dimension_value"], "project": ["dimension_value"], "provider": ["provider_id"], "profile": ["provider_id", "profile_id"]}[kind]
    rows = rollup.filter(F.col("dimension") == (kind if kind in ("model", "project") else "all"))
    got = in_range(rows, [(0, start, end)]).groupBy(*keys).agg(*merged_metrics())
    return got.orderBy(F.desc("sum_total_tokens"), F.desc("event_count"), *keys).limit(limit)


def with_lookahead(rows: DataFrame, order: list[Column | str], size: int) -> DataFrame:
    """The first `size` rows in order, with `has_more`: whether others follow."""
    size = max(1, min(size, PAGE))
    few = rows.orderBy(*order).limit(size + 1)
    ranked = few.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # at most size + 1 rows
    return ranked.withColumn("has_more", F.max("n").over(Window.partitionBy()) > size).filter(F.col("n") <= size).drop("n")


def full_analytics(rollup: DataFrame, start: int, end: int, targets: list[tuple[int, int, int]], scopes: list[tuple[str, str]] = (), limit: int = ITEMS, zone: str | None = None) -> DataFrame:
    """Overview, days, the four breakdowns and, with a zone, the rhythm, in one pass and one shuffle: (kind, key, key2, metrics, rank, truncated).

    kind is overview, day, model, project, provider, profile, hour, weekday or cell. A breakdown has its first `limit`
    items by tokens; the rhythm has the cells in which something happened.
    """
    rows = scoped(rollup, list(scopes))
    met = in_range(rows, [(-1, start, end), *targets]).withColumns({"hour": F.lit(None).cast("long"), "weekday": F.lit(None).cast("long")})
    if zone is not None:
        clock = rhythm_buckets(rollup.sparkSession, start, end, zone)
        local = rows.filter((F.col("dimension") == "all") & F.col("bucket_start").between(start, end)).join(F.broadcast(clock), ["bucket_width", "bucket_start"])
        met = met.unionByName(local.withColumn("target", F.lit(-2).cast("long")))
    one = lambda kind, key, key2: F.struct(F.lit(kind).alias("kind"), key.alias("key"), key2.alias("key2"))
    none = F.lit("")
    text = lambda c: c.cast("string")
    hour, weekday = F.col("hour"), F.col("weekday")
    of_all = F.array(one("overview", none, none), one("provider", F.col("provider_id"), none), one("profile", F.col("provider_id"), F.col("profile_id")))
    day = F.array(one("day", text(F.col("target")), none))
    beat = F.array(one("hour", text(hour), none), one("weekday", text(weekday), none), one("cell", text(weekday * 24 + hour), none))
    item = F.array(F.struct(F.col("dimension").alias("kind"), F.col("dimension_value").alias("key"), none.alias("key2")))
    whole = F.col("target") == -1
    keys = F.when(F.col("target") == -2, beat).when(F.col("dimension") == "all", F.when(whole, of_all).otherwise(day)).when(whole, item)
    sums = met.withColumn("k", F.explode(keys)).groupBy("k").agg(*merged_metrics()).select("k.*", *METRICS)
    by = Window.partitionBy("kind").orderBy(F.desc("sum_total_tokens"), F.desc("event_count"), "key", "key2")
    # ranks beyond what any kind shows are dropped before they are shuffled, so no task sees all projects
    ranked = sums.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= max(limit + 1, TARGETS))
    cut = F.col("kind").isin("model", "project", "provider", "profile") & (F.col("rank") > limit)
    return ranked.withColumn("truncated", F.max(cut).over(Window.partitionBy("kind"))).filter(~cut)


def rhythm_sums(rollup: DataFrame, clock: DataFrame) -> DataFrame:
    """(grouping, metrics): what the rhythm's hours, weekdays and cells add up to; each must be the overview of the same range."""
    groupings = {"hours": (F.col("hour"), 24), "weekdays": (F.col("weekday"), 7), "cells": (F.col("weekday") * 24 + F.col("hour"), 168)}
    out = None
    for name, (key, cells) in groupings.items():
        one = rhythm(rollup, clock, key, cells).agg(*merged_metrics()).select(F.lit(name).alias("grouping"), *METRICS)
        out = one if out is None else out.unionByName(one)
    return out


def broken_metrics(rollup: DataFrame) -> DataFrame:
    """Rollup rows whose metrics cannot be: more fallbacks or known counts than events, contexts that do not add up, counts under zero."""
    events = F.col("event_count")
    known = F.greatest(*[F.col(m) for m in METRICS if m.startswith("known_")])
    contexts = F.col("long_yes") + F.col("long_no") + F.col("long_unavailable")
    return rollup.filter((F.col("fallback_events") > events) | (known > events) | (contexts != events) | (F.least(*map(F.col, METRICS)) < 0))


def cursor(dataset: str, *key: object) -> tuple:
    """A place in a page walk, bound to the dataset it was read from."""
    return (dataset, *key)


def resume(at: tuple | None, dataset: str) -> tuple | None:
    """The key of a cursor; one of another dataset is stale."""
    if at is not None and at[0] != dataset:
        raise ValueError("stale revision: the cursor belongs to another dataset")
    return None if at is None else tuple(at[1:])


def probe_page(rows: DataFrame, size: int, before: int | None = None, key: str = "id") -> DataFrame:
    """Rows by falling id, before an id if one is given; the size is held to 1 to 256."""
    some = rows if before is None else rows.filter(F.col(key) < before)
    return some.orderBy(F.desc(key)).limit(max(1, min(size, PAGE)))


def rhythm(rollup: DataFrame, clock: DataFrame, key: Column, cells: int) -> DataFrame:
    """Metrics of each local hour, weekday or cell (dense from 0), from the buckets of `rhythm_buckets`."""
    rows = rollup.filter(F.col("dimension") == "all")
    found = rows.join(F.broadcast(clock), ["bucket_width", "bucket_start"]).groupBy(key.alias("cell")).agg(*merged_metrics())  # at most 30 days of minutes
    every = rollup.sparkSession.range(cells).withColumnRenamed("id", "cell")
    return every.join(found, "cell", "left").fillna(0, list(METRICS))


def lifetime(rollup: DataFrame) -> DataFrame:
    return rollup.filter((F.col("bucket_width") == 3600) & (F.col("dimension") == "all")).agg(*merged_metrics())


def horizon(rollup: DataFrame) -> tuple[int, int]:
    """The first second and the end of what a stored rollup holds, from its hours alone."""
    hours = rollup.filter((F.col("bucket_width") == 3600) & (F.col("dimension") == "all"))
    first, last = hours.agg(F.min("bucket_start"), F.max("bucket_start")).first()
    return (first, last + 3600) if first is not None else (0, 0)


def span(rows: DataFrame, at: str) -> tuple[int, int]:
    """The first second and the end of a store's own rows."""
    first, last = rows.agg(F.min(at), F.max(at)).first()
    return (first, last + 1) if first is not None else (0, 0)


def newest(rows: DataFrame, at: str, size: int, bounds: tuple[int, int], upto: int | None = None) -> DataFrame:
    """Rows of a last stretch of time up to `upto` that has `size` of them: an hour, then eight times as long until it is full.

    Bounds on the sorted column are plain comparisons, so a store in its order reads the row groups of that stretch alone.
    """
    first, end = bounds
    last, span = end if upto is None else min(upto, end), 3600
    while True:
        some = rows.filter(F.col(at).between(last - span, last))
        if last - span <= first or some.limit(size).count() >= size:
            return some
        span *= 8


def _before(key: list[tuple[str, object]]) -> Column:
    """Rows whose key, in falling order, comes after this one; the first bound stands by itself, so that it reaches the files."""
    out = F.lit(False)
    for column, value in reversed(key):
        out = (F.col(column) < F.lit(value)) | ((F.col(column) == F.lit(value)) & out)
    return (F.col(key[0][0]) <= F.lit(key[0][1])) & out


def activity_page(events: DataFrame, size: int = PAGE, before: tuple[int, int, str] | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Newest events first; `before` is the key of the last row of the page before. With bounds, only a stretch that fills the page is read."""
    if before:
        events = events.filter(_before(list(zip(_EVENT_KEY, before, strict=True))))
    if bounds is not None:
        events = newest(events, _EVENT_KEY[0], min(size, PAGE), bounds, before and before[0])
    return events.orderBy(*map(F.desc, _EVENT_KEY)).limit(min(size, PAGE))


_EVENT_KEY = ("timestamp_seconds", "timestamp_nanos", "fingerprint")


def session_page(sessions: DataFrame, size: int = PAGE, after: tuple[int, int, str, str, str] | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Sessions by their last moment, newest first, then by name; `after` is the key of the last row of the page before."""
    rows, names = sessions.filter(F.col("dimension") == "all"), ("provider_id", "profile_id", "session_id")
    if after:
        s, n, *ids = after
        same = (F.col("last_seconds") == s) & (F.col("last_nanos") == n) & (F.struct(*names) > F.struct(*[F.lit(v).alias(k) for k, v in zip(names, ids, strict=True)]))
        rows = rows.filter((F.col("last_seconds") <= s) & (_before([("last_seconds", s), ("last_nanos", n)]) | same))
    if bounds is not None:
        rows = newest(rows, "last_seconds", min(size, PAGE), bounds, after and after[0])
    return rows.orderBy(F.desc("last_seconds"), F.desc("last_nanos"), *names).limit(min(size, PAGE))


def cursor_page(events: DataFrame, dataset: str, at: tuple | None, size: int = PAGE, bounds: tuple[int, int] | None = None) -> tuple[DataFrame, tuple | None]:
    """A page of the dataset and the cursor of the next one; a cursor of another dataset is refused (ValueError)."""
    page = activity_page(events, size, resume(at, dataset), bounds)
    rows = page.select(*_EVENT_KEY).collect()  # at most PAGE keys
    return page, cursor(dataset, *rows[-1]) if len(rows) == min(size, PAGE) else None


def session_detail(sessions: DataFrame, provider: str, profile: str, session: str, dimension: str = "all") -> DataFrame:
    rows = sessions.filter((F.col("provider_id") == provider) & (F.col("profile_id") == profile) & (F.col("session_id") == session) & (F.col("dimension") == dimension))
    return rows if dimension == "all" else rows.orderBy(F.desc("sum_total_tokens"), F.desc("event_count"), "dimension_value").limit(ITEMS)


def legacy_events(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events of the old layout with the provider of their source; `unknown` where it is missing or of another profile.

    Few files hold all events, so each file's events are spread over PARTS parts, and its source is given to each.
    """
    part = F.pmod(F.xxhash64(*events.columns), F.lit(PARTS)).cast("int")
    of = sources.select(F.col("file_key").alias("selected_file_key"), F.col("provider_id").alias("source_provider"), F.col("profile_id").alias("source_profile"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    provider = F.when(F.col("source_profile") == F.col("profile_id"), F.col("source_provider")).otherwise("unknown")
    joined = events.withColumn("__part", part).drop("provider_id").join(of, ["selected_file_key", "__part"], "left")
    return joined.withColumn("provider_id", provider).drop("source_provider", "source_profile", "__part")


def legacy_page(events: DataFrame, sources: DataFrame, size: int = PAGE) -> DataFrame:
    """The newest events of the old layout with their provider; each event has a row at least, so the page is taken before the join."""
    return activity_page(legacy_events(activity_page(events, size), sources), size)
