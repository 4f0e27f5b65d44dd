"""File streams and running them to the end of what has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "parquet",
    max_files_per_batch: int | None = None,
) -> DataFrame:
    """New files under a path as a stream; the schema is always given.

    A path that names a single file is turned into a pattern, because a stream
    reads folders and patterns only.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    if path.endswith(f".{fmt}"):
        path = f"{path[:-1]}[{path[-1]}]"
    return reader.load(path)


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Declare the event time; a timestamp without zone is taken in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process everything that is there, then stop; the checkpoint makes the next run go on from it."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append finished rows to a Parquet folder, each exactly once."""
    return run_available(df.writeStream.outputMode(mode).format("parquet").option("path", path), checkpoint)


def to_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch and its id to a function that writes it."""
    return run_available(df.writeStream.outputMode(mode).foreachBatch(handle), checkpoint)
