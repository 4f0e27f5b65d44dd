"""Mean and spread of numeric columns in two batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import name_of, rows_from_sql, struct_sql, text_literal


def mean_shift(current: DataFrame, reference: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """One row per column with both means, both deviations and the relative shift of the mean.

    Both batches go through a single aggregation: rows carry the side they came
    from and each aggregate looks at one side only. The shift is NULL when the
    reference mean is NULL or zero; a missing current mean counts as zero.
    """
    columns = list(columns)

    def tagged(df: DataFrame, is_current: bool) -> DataFrame:
        return df.select(F.lit(is_current).alias("__current"), *[F.col(c).cast("double").alias(c) for c in columns])

    both = tagged(current, True).unionByName(tagged(reference, False))
    stats, structs = [], []
    for i, c in enumerate(columns):
        for side, condition in (("cur", "__current"), ("ref", "NOT __current")):
            stats.append(F.expr(f"avg({name_of(c)}) FILTER (WHERE {condition}) AS {side}_mean{i}"))
            stats.append(F.expr(f"stddev({name_of(c)}) FILTER (WHERE {condition}) AS {side}_sd{i}"))
        shift = f"try_divide(abs(coalesce(cur_mean{i}, 0.0D) - ref_mean{i}), abs(ref_mean{i}))"
        structs.append(
            struct_sql(
                column=text_literal(c),
                current_mean=f"cur_mean{i}",
                reference_mean=f"ref_mean{i}",
                current_stddev=f"cur_sd{i}",
                reference_stddev=f"ref_sd{i}",
                relative_mean_shift=f"round({shift}, {digits})",
            )
        )
    return both.agg(*stats).select(rows_from_sql(structs))
