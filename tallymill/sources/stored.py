"""Rollups kept as Parquet, split by bucket width (and dimension) and sorted by bucket, and the stores of a dataset.

A store is written to a folder of its own and then named by a pointer, which is made only where there is none: of two
first readers both may build, one is published, and both read that one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.checkpoints import shared_folder
from tallymill.functions.measures import METRICS
from tallymill.operators.rollup import PRICE_KEYS, PRICE_SESSION_KEYS, PRICE_SUMS, PRICE_TIME_KEYS, SESSION_KEYS, TIME_KEYS, price_session_rollup, price_widths, session_rollup, time_rollup

PARTITIONS = ("bucket_width", "dimension")
#: Raised when what a rollup holds changes, so that changed code reads no old store.
VERSION = 2
#: Bytes of a row group of stores that pages read.
ROW_GROUP = 1 << 20
SCHEMA = "bucket_start bigint, provider_id string, profile_id string, dimension_value string, " + ", ".join(f"{m} bigint" for m in METRICS) + ", bucket_width bigint, dimension string"
_PRICED = ", ".join(f"{k} string" for k in ("provider_id", "profile_id", "project", *PRICE_KEYS)) + ", " + ", ".join(f"{s} bigint" for s in PRICE_SUMS)
PRICE_SCHEMA = f"bucket_start bigint, {_PRICED}, bucket_width bigint"
SESSION_SCHEMA = f"session_id string, {_PRICED}"


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a job has written that folder to its end."""
    files, done = _file(spark, f"{path}/_SUCCESS")
    return files.exists(done)


def _write(rows: DataFrame, path: str, split: tuple[str, ...], *order: str) -> None:
    # ranges are of like size, so a month of all projects is many tasks' work, and each file holds a run of buckets
    rows.repartitionByRange(*split, *order).sortWithinPartitions(*split, *order).write.mode("overwrite").partitionBy(*split).parquet(path)


def write(rollup: DataFrame, path: str) -> None:
    _write(rollup, path, PARTITIONS, "bucket_start")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(*TIME_KEYS, *METRICS)


def fingerprint(spark: SparkSession, files: str) -> str:
    """Names, sizes and times of a dataset's files as one name; a changed dataset has another."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(files).select("path", "length", "modificationTime")
    n, h = listed.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime"))), F.lit(0))).first()
    return f"{n}-{h & (1 << 64) - 1:016x}"


def published(spark: SparkSession, path: str, build: Callable[[str], None]) -> str:
    """The folder that stands for a store: the one that its pointer names, built and published where there is none yet."""
    files, pointer = _file(spark, f"{path}/_current")
    if not files.exists(pointer):
        name = uuid.uuid4().hex
        build(f"{path}/{name}")
        try:
            out = files.create(pointer, False)
            out.write(name.encode())
            out.close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
    return f"{path}/{_content(spark, f'{path}/_current')}"


def _content(spark: SparkSession, path: str) -> str:
    files, at = _file(spark, path)
    given = files.open(at)
    text = bytes(given.readAllBytes()).decode()
    given.close()
    return text


def stored_rollup(spark: SparkSession, events: DataFrame, files: str) -> DataFrame:
    """The time rollup of a dataset, built once and read from the shared folder after.

    Names, sizes and times of the files that the events come from name the store, so a changed dataset has a new one.
    """
    path = f"{shared_folder(spark)}/rollup-{VERSION}-{fingerprint(spark, files)}"
    return read(spark, published(spark, path, lambda at: write(time_rollup(events), at)))


def stored_prices(spark: SparkSession, events: DataFrame, files: str) -> DataFrame:
    """The price rollup of a dataset by minutes and hours (PRICE_TIME_KEYS and PRICE_SUMS), kept like the time rollup."""
    path = f"{shared_folder(spark)}/prices-{VERSION}-{fingerprint(spark, files)}"
    at = published(spark, path, lambda at: _write(price_widths(events), at, ("bucket_width",), "bucket_start"))
    return spark.read.schema(PRICE_SCHEMA).parquet(at).select(*PRICE_TIME_KEYS, *PRICE_SUMS)


def stored_events(spark: SparkSession, events: DataFrame, files: str) -> DataFrame:
    """The events of a dataset (with their identity) in order of time, in small row groups, for pages; kept like the time rollup."""
    path = f"{shared_folder(spark)}/events-{VERSION}-{fingerprint(spark, files)}"
    order = ("timestamp_seconds", "timestamp_nanos", "fingerprint")
    at = published(spark, path, lambda at: events.repartitionByRange(order[0]).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP).parquet(at))
    return spark.read.schema(events.schema).parquet(at)


def stored_sessions(spark: SparkSession, events: DataFrame, files: str) -> DataFrame:
    """The session rollup of a dataset by dimension, that of `all` in order of each session's last moment."""
    path = f"{shared_folder(spark)}/sessions-{VERSION}-{fingerprint(spark, files)}"
    rows = session_rollup(events)

    def build(at: str) -> None:
        order = ("dimension", "last_seconds", *SESSION_KEYS[:3])
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP).partitionBy("dimension").parquet(at)

    got = spark.read.schema(rows.schema).parquet(published(spark, path, build))
    return got.select(*rows.columns)


def stored_session_prices(spark: SparkSession, events: DataFrame, files: str) -> DataFrame:
    """The price rollup of a dataset by sessions, sorted by session, so that one session's rows are few row groups."""
    path = f"{shared_folder(spark)}/session-prices-{VERSION}-{fingerprint(spark, files)}"
    at = published(spark, path, lambda at: price_session_rollup(events).repartitionByRange(*PRICE_SESSION_KEYS[:3]).sortWithinPartitions(*PRICE_SESSION_KEYS[:3]).write.parquet(at))
    return spark.read.schema(SESSION_SCHEMA).parquet(at).select(*PRICE_SESSION_KEYS, *PRICE_SUMS)

