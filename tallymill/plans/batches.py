"""Replaying tables as streams: a folder with one file for each batch, read one file at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymill.functions.checkpoints import shared_folder
from tallymill.streaming.state import drained


def source(spark: SparkSession, batches: list[DataFrame]) -> DataFrame:
    """A stream that gives each frame as a batch of its own, in order."""
    path = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)  # a file is a batch
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def streamed(spark: SparkSession, batches: list[DataFrame], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that a streaming operator gives for the batches."""
    at = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    return drained(run(source(spark, batches)), f"{at}/rows", f"{at}/checkpoint")


def applied(spark: SparkSession, batches: list[DataFrame], apply: Callable[[DataFrame, int], None], rows: int = 0) -> None:
    """Give a store each frame as a batch of a stream; a batch is many files, so writing and reading it is many tasks' work.

    Files have at most so many rows, if told: where tasks write unlike shares, those that read take like ones.
    """
    at = f"{shared_folder(spark)}/applied-{uuid.uuid4().hex}"
    for batch in batches:
        batch.write.option("maxRecordsPerFile", rows).mode("append").parquet(f"{at}/batches")
        # all files that are new are one batch, worked off before the next one comes
        stream = spark.readStream.schema(batches[0].schema).parquet(f"{at}/batches")
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
