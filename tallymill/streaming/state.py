"""Starting stateful queries: the state store that they need, and a sink that is read after."""

from __future__ import annotations

from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Within it, queries that start keep their state in RocksDB, which transformWithState needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


def drained(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Work off what a stream has, append its rows below a path, and read all that is there."""
    with rocks(rows.sparkSession):
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
