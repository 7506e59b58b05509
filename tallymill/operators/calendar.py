"""Local-day ranges, their UTC bounds, minute/hour/minute segments and hour-by-weekday exposure."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DAYS, RHYTHM_DAYS, HOUR, MINUTE = 400, 30, 3600, 60


def day_start(day: date, zone: str) -> int:
    """UTC second at which a local day begins: gaps move forward, folds take the earlier instant."""
    naive, tz = datetime(day.year, day.month, day.day), ZoneInfo(zone)
    at = naive.replace(tzinfo=tz, fold=0)
    if at.astimezone(UTC).astimezone(tz).replace(tzinfo=None) != naive:
        # in a gap, the offset before it gives the instant at which clocks jump at the latest
        at = naive.replace(tzinfo=tz, fold=0)
    seconds = int(at.timestamp())
    if seconds % MINUTE:
        raise ValueError("a day does not begin on a whole minute")
    return seconds


def week_start(day: date, first_weekday: int) -> date:
    return day - timedelta((day.weekday() - first_weekday) % 7)


def month_bounds(day: date) -> tuple[date, date]:
    first = day.replace(day=1)
    return first, (first + timedelta(32)).replace(day=1)


def resolve(kind: str, today: date, *, days: int = 1, start: date | None = None, end: date | None = None, first_weekday: int = 0) -> tuple[date, date]:
    """Half-open local dates of a range: today, recent (1 to 400 days), day, week, month or custom (at most 400 days)."""
    if kind == "recent" and not 1 <= days <= MAX_DAYS:
        raise ValueError("recent days are 1 to 400")
    if kind in ("today", "recent"):
        return today - timedelta(days - 1 if kind == "recent" else 0), today + timedelta(1)
    if start is None:
        raise ValueError(f"{kind} needs a start")
    if kind == "day":
        return start, start + timedelta(1)
    if kind == "week":
        first = week_start(start, first_weekday)
        return first, first + timedelta(7)
    if kind == "month":
        return month_bounds(start)
    if kind != "custom" or end is None or not 0 < (end - start).days <= MAX_DAYS:
        raise ValueError("a custom range has 1 to 400 days")
    return start, end


@dataclass(frozen=True)
class Segment:
    width: int
    start: int
    end: int


def segments(start: int, end: int) -> list[Segment]:
    """A minute head, an hour middle and a minute tail that cover a minute-aligned range once."""
    if start % MINUTE or end % MINUTE or end < start:
        raise ValueError("a range is minute-aligned and not negative")
    a, b = -(-start // HOUR) * HOUR, end // HOUR * HOUR
    if a >= b:
        return [Segment(MINUTE, start, end)] if end > start else []
    return [s for s in (Segment(MINUTE, start, a), Segment(HOUR, a, b), Segment(MINUTE, b, end)) if s.start < s.end]


def segment_buckets(spark: SparkSession, targets: list[tuple[int, int, int]]) -> DataFrame:
    """(target, bucket_width, bucket_start) of each (target, start, end): a range join as an equi-join."""
    rows = [(t, s.width, s.start, s.end) for t, a, b in targets for s in segments(a, b)]
    frame = spark.createDataFrame(rows, "target long, bucket_width long, a long, b long")
    return frame.select("target", "bucket_width", F.explode(F.sequence("a", F.col("b") - F.col("bucket_width"), "bucket_width")).alias("bucket_start"))


def day_targets(first: date, last: date, zone: str) -> list[tuple[int, int, int]]:
    """(day number from the first, UTC start, UTC end) of each local day."""
    return [(k, day_start(first + timedelta(k), zone), day_start(first + timedelta(k + 1), zone)) for k in range((last - first).days)]


def local_clock(seconds: Column, zone: str) -> Column:
    """The clock time of a zone at UTC seconds, as a timestamp without zone, whatever the session's own zone."""
    utc = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_day(seconds: Column, first: date, zone: str) -> Column:
    """Number of the local day from `first`; days have 23 to 25 hours where clocks change."""
    return F.date_diff(local_clock(seconds, zone).cast("date"), F.lit(first)).cast("bigint")


def rhythm_minutes(spark: SparkSession, start: int, end: int, zone: str) -> DataFrame:
    """(minute, hour, weekday, date, offset) of every minute of a range, by local clock; weekdays from Monday = 0, offset in seconds from UTC."""
    local = local_clock(F.col("id"), zone)
    offset = F.timestamp_diff("SECOND", F.timestamp_add("SECOND", F.col("id"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), local)
    return spark.range(start, end, MINUTE).select(F.col("id").alias("minute"), F.hour(local).cast("bigint").alias("hour"), F.weekday(local).cast("bigint").alias("weekday"), local.cast("date").alias("date"), offset.cast("bigint").alias("offset"))


def rhythm_buckets(spark: SparkSession, start: int, end: int, zone: str) -> DataFrame:
    """(bucket_width, bucket_start, hour, weekday) that cover a range of at most 30 days once, each within one local hour.

    An hour of UTC is one bucket where it is one local hour, by its offset at both ends; else it is its minutes.
    """
    if end - start > RHYTHM_DAYS * 86_400 + 2 * HOUR:
        raise ValueError("a rhythm has at most 30 days")
    at = spark.createDataFrame([(s.width, s.start, s.end) for s in segments(start, end)], "w long, a long, z long").select("w", F.explode(F.sequence("a", F.col("z") - F.col("w"), "w")).alias("at"))
    offset = lambda s: F.timestamp_diff("SECOND", F.timestamp_add("SECOND", s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), local_clock(s, zone))
    one = (F.col("w") == MINUTE) | ((offset(F.col("at")) == offset(F.col("at") + HOUR - MINUTE)) & (offset(F.col("at")) % HOUR == 0))
    width = F.when(one, F.col("w")).otherwise(F.lit(MINUTE)).cast("long")
    each = at.select(width.alias("bucket_width"), F.explode(F.when(one, F.array("at")).otherwise(F.sequence("at", F.col("at") + HOUR - MINUTE, F.lit(MINUTE).cast("long")))).alias("bucket_start"))
    local = local_clock(F.col("bucket_start"), zone)
    return each.select("bucket_width", "bucket_start", F.hour(local).cast("long").alias("hour"), F.weekday(local).cast("long").alias("weekday"))


def exposure(spark: SparkSession, start: int, end: int, zone: str, key: str) -> DataFrame:
    """Elapsed minutes of each local hour or weekday in a range, and its occurrences: runs of one date, hour and offset from UTC."""
    run = F.struct("date", "offset", "hour")
    return rhythm_minutes(spark, start, end, zone).groupBy(key).agg(F.count("*").alias("elapsed_minutes"), F.count_distinct(run).alias("occurrences"))
