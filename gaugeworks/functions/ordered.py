"""Per-key ordering that survives a key holding a large part of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.joins import join_null_safe
from gaugeworks.workspace import fresh_path

_SLICE = "__slice"
# Above this rank Spark no longer prunes inside the map tasks (its default setting).
_PRUNED_RANK = 1000


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    For a small ``n`` Spark keeps only ``n`` rows per group and map task before
    the shuffle. For a large one the group is ranked in 256 slices first.
    """
    if n >= _PRUNED_RANK:
        rest = [c for c in df.columns if c not in group]
        sliced = df.withColumn(_SLICE, F.pmod(F.xxhash64(*rest), F.lit(256)))
        local = Window.partitionBy(*group, _SLICE).orderBy(*order)
        df = sliced.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= n).drop("__r", _SLICE)
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in ranges of equal size by ``order``, stored, with the range's number as ``__slice``.

    Range numbers do not decrease along the order, and equal rows share one. Runs at
    once: the ranges are drawn from a sample, so they are fixed by writing them.
    """
    path = fresh_path(df.sparkSession, "ranges")
    numbered = df.repartitionByRange(*order).withColumn(_SLICE, F.spark_partition_id())
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def _sliced(df: DataFrame, order: Sequence[str], slice_of: Column | None) -> DataFrame:
    return in_ranges(df, order) if slice_of is None else df.withColumn(_SLICE, slice_of)


def previous_value(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, slice_of: Column | None, name: str
) -> DataFrame:
    """``lag(value)`` per group, computed in slices so that one group is many tasks.

    ``slice_of`` must not decrease along ``order``, e.g. the day of the first order
    column. Without it the rows are first cut into ranges of equal size, whatever
    group and time they are of, which runs at once. Only one row per group and slice
    takes part in the second, per-group window.
    """
    group, order = list(group), list(order)
    sliced = _sliced(df, [*group, *order], slice_of)
    local = Window.partitionBy(*group, _SLICE).orderBy(*order)
    lagged = sliced.withColumn("__prev", F.lag(F.struct(value)).over(local))
    last = sliced.groupBy(*group, _SLICE).agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*group).orderBy(_SLICE)
    carried = last.select(*group, _SLICE, F.lag("__last").over(across).alias("__carried"))
    joined = join_null_safe(lagged, carried, [*group, _SLICE], "left")
    picked = F.coalesce("__prev", "__carried")[value]
    return joined.select(*df.columns, picked.alias(name))


def running_number(
    df: DataFrame, group: Sequence[str], order: Sequence[str], slice_of: Column | None, name: str
) -> DataFrame:
    """``row_number()`` per group, computed in slices; see :func:`previous_value`."""
    group, order = list(group), list(order)
    sliced = _sliced(df, [*group, *order], slice_of)
    local = Window.partitionBy(*group, _SLICE).orderBy(*order)
    numbered = sliced.withColumn("__n", F.row_number().over(local).cast("bigint"))
    counts = sliced.groupBy(*group, _SLICE).agg(F.count(F.lit(1)).alias("__count"))
    across = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, _SLICE, F.coalesce(F.sum("__count").over(across), F.lit(0)).alias("__before"))
    joined = join_null_safe(numbered, before, [*group, _SLICE], "inner")
    return joined.select(*df.columns, (F.col("__before") + F.col("__n")).alias(name))
