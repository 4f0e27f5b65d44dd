"""Delta tables, for sessions that were started with Delta Lake.

Nothing here is imported by the rest of the package; without Delta the keyed
tables in :mod:`gaugeworks.sources.keyed` do the same work on plain Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.errors import SinkError, SourceError
from gaugeworks.functions.columns import name_of


def has_delta(spark: SparkSession) -> bool:
    return "DeltaSparkSessionExtension" in (spark.conf.get("spark.sql.extensions", "") or "")


def merge_into(batch: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Upsert a batch into an existing Delta table by key."""
    spark = batch.sparkSession
    if not has_delta(spark):
        raise SinkError("this session has no Delta Lake; use a keyed table")
    if not keys:
        raise SinkError("an upsert needs at least one key column")
    condition = " AND ".join(f"t.{name_of(k)} = s.{name_of(k)}" for k in keys)
    spark.sql(
        f"MERGE INTO delta.{name_of(path)} t USING {{batch}} s ON {condition} "
        "WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *",
        batch=batch,
    )


def read_changes(
    spark: SparkSession, path: str, starting_version: int | None = None, starting_timestamp: str | None = None
) -> DataFrame:
    """The change feed of a Delta table that records one; the version wins when both are given."""
    if not has_delta(spark):
        raise SourceError("this session has no Delta Lake; use the changes of a keyed table")
    if starting_version is None and starting_timestamp is None:
        raise SourceError("an incremental read needs starting_version or starting_timestamp")
    start = ("startingVersion", starting_version) if starting_version is not None else ("startingTimestamp", starting_timestamp)
    return spark.read.format("delta").options(readChangeFeed=True).option(*start).load(path)
