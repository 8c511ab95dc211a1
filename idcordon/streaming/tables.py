"""Read tables as streams and write streams to tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from idcordon.sources.shared import shared_dir


def parquet_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """New files at ``path`` as a stream; the number of files bounds a micro-batch.

    ``path`` may be a folder or a single file. A stream takes a single file only when a
    glob names it, so the last character is written as a class of one.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def drain(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> str:
    """Write all that has arrived to a Parquet table and stop; gives the table's path.

    Started again with the same paths it goes on where it stopped and writes nothing twice. Streams
    that hand rows on in order need ``rocks`` around it.
    """
    spark = stream.sparkSession
    path = path or shared_dir(spark, "stream-out")
    checkpoint = checkpoint or shared_dir(spark, "stream-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path
