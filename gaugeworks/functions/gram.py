"""Correlations of many columns from one product of vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import name_of

# Rows from which the point is taken that the numbers are measured from; any point gives the same result up to rounding.
_LOOKED_AT = 100
# Columns of one product; more are taken block by block. Its size on the driver is (4 * 2 * BLOCK)^2 doubles.
BLOCK = 256
# Rounding that a variance may hold, in relation to the mean square it is the difference of.
_ROUNDING = 1e-13


def complete_pairs(df: DataFrame, columns: Sequence[str], nulls_as_zero: bool = False) -> DataFrame:
    """(column_a, column_b, correlation) of every pair over the rows that have both values.

    Each row becomes one vector of, per column, whether it has a value, the value,
    its square and whether it is NaN or infinite. The sum of these vectors' products
    with themselves, merged as a tree, holds for each pair the number of common
    rows, the sums and squares over them and the cross product. Runs at once; the
    table is read once for up to ``2 * BLOCK`` columns.
    """
    columns = list(columns)
    blocks = [columns[k : k + BLOCK] for k in range(0, len(columns), BLOCK)]
    found: dict[tuple[str, str], float | None] = {}
    if len(blocks) <= 2:
        found = _products(df, columns, nulls_as_zero)
    else:
        for k, a in enumerate(blocks):
            for b in blocks[k + 1 :]:
                found.update(_products(df, a + b, nulls_as_zero))
    rows = [(a, b, found[a, b]) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def _products(df: DataFrame, columns: Sequence[str], nulls_as_zero: bool) -> dict[tuple[str, str], float | None]:
    number = [f"double({name_of(c)})" for c in columns]
    if nulls_as_zero:
        number = [f"coalesce({v}, 0.0D)" for v in number]
    values = df.select(*[F.expr(f"{v} AS v{i}") for i, v in enumerate(number)])
    near = values.limit(_LOOKED_AT).collect()
    parts: list[str] = []
    for i in range(len(columns)):
        seen = next((r[i] for r in near if r[i] is not None and math.isfinite(r[i])), 0.0)
        odd = f"(isnan(v{i}) OR abs(v{i}) = double('Infinity'))"
        z = f"if(v{i} IS NULL OR {odd}, 0.0D, v{i} - {seen!r}D)"
        parts += [f"if(v{i} IS NULL, 0.0D, 1.0D)", z, f"{z} * {z}", f"if(v{i} IS NOT NULL AND {odd}, 1.0D, 0.0D)"]
    vectors = values.select(array_to_vector(F.expr(f"array({', '.join(parts)})")).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), 0, len(parts)).computeGramianMatrix().toArray()
    has, value, square, odd = (slice(k, None, 4) for k in range(4))
    n, spoiled = gram[has, has], gram[odd, has]
    total, squares, cross = gram[value, has], gram[square, has], gram[value, value]
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = squares - total * total / n
        variance[variance <= _ROUNDING * squares] = 0.0
        covariance = cross - total * total.T / n
        correlation = covariance / np.sqrt(variance) / np.sqrt(variance.T)
    found: dict[tuple[str, str], float | None] = {}
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            if spoiled[i, j] or spoiled[j, i]:
                found[a, columns[j]] = math.nan
            elif n[i, j] < 1 or not (variance[i, j] > 0 and variance[j, i] > 0):
                found[a, columns[j]] = None
            else:
                found[a, columns[j]] = float(min(1.0, max(-1.0, correlation[i, j])))
    return found
