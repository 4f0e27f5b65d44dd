"""Joins that keep NULLs or survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from gaugeworks.functions.columns import all_set

_TRACKED = 4096


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where NULL equals NULL, with each key once in the result."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__right_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def common_types(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[DataType]:
    """The type in which Spark compares each key of the two sides, from their schemas alone."""
    nothing = left.sparkSession.range(0)
    kinds = [
        F.coalesce(F.lit(None).cast(left.schema[k].dataType), F.lit(None).cast(right.schema[k].dataType)) for k in keys
    ]
    return [f.dataType for f in nothing.select(*kinds).schema.fields]


def hot_hashes(df: DataFrame, hashed: Column, hot_share: float) -> list[int]:
    """Hashes that at least ``hot_share`` of the rows have, at most ``1 / hot_share``.

    One scan into a fixed-size sketch; no rows are shuffled. The sketch may miss or
    add a hash, which changes where rows are joined, never the result.
    """
    most = int(1 / hot_share)
    found = df.select(hashed.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {_TRACKED})").alias("top")
    ).first()
    return [entry["item"] for entry in (found["top"] or []) if entry["count"] >= found["n"] * hot_share]


def lookup_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot_share: float | None = None
) -> DataFrame:
    """Join rows to the ``right`` rows of their key (``how``: inner or left); NULL keys match nothing.

    The plan is one join, whose skewed partitions Spark splits at run time. With
    ``hot_share`` the keys with that share of the left rows are looked for first, by
    a scan of the key columns that runs at once, and their rows are spread: each
    left row takes one of as many numbers as there are shuffle partitions, and the
    hot keys' right rows are repeated for each number. The result is the same.
    Strings that a collation holds for equal hash apart, so hot keys with one are
    told by comparing values.
    """
    keys = list(keys)
    right = right.where(all_set(keys))
    if hot_share is None:
        return left.join(right, keys, how)
    kinds = common_types(left, right, keys)
    hashed = F.xxhash64(*[F.col(k).cast(kind) for k, kind in zip(keys, kinds)])
    hot = hot_hashes(left, hashed, hot_share)
    if not hot:
        return left.join(right, keys, how)
    spread = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number, flag = "__number", "__hot"
    if any("collate" in kind.simpleString() for kind in kinds):
        values = _hot_values(left, keys, kinds, hashed.isin(hot), flag)
        left, right = (_marked(df, values, keys, flag) for df in (left, right))
        is_hot = F.col(flag).isNotNull()
    else:
        is_hot = hashed.isin(hot)
    part = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(spread))).otherwise(F.lit(0))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    numbered = left.withColumn(number, part.cast("int")).drop(flag)
    repeated = right.withColumn(number, F.explode(parts)).drop(flag)
    return numbered.join(repeated, [*keys, number], how).drop(number)


def _hot_values(df: DataFrame, keys: Sequence[str], kinds: Sequence[DataType], hot: Column, flag: str) -> DataFrame:
    """The hot keys themselves, each once in the sense of its collation; there are no more than hot hashes."""
    typed = df.where(hot).select(*[F.col(k).cast(kind).alias(k) for k, kind in zip(keys, kinds)]).where(all_set(keys))
    found = typed.distinct()
    return df.sparkSession.createDataFrame(found.collect(), found.schema).withColumn(flag, F.lit(True))


def _marked(df: DataFrame, values: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    named = values.withColumnsRenamed({k: f"__hot_{k}" for k in keys})
    same = [F.col(k) == F.col(f"__hot_{k}") for k in keys]
    joined = df.join(F.broadcast(named), same, "left")
    return joined.drop(*[f"__hot_{k}" for k in keys])
