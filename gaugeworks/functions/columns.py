"""Small expressions that return a Column; all of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_literal(value: str) -> str:
    """A string as SQL text."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def name_of(column: str) -> str:
    """A column name as SQL text."""
    return "`" + column.replace("`", "``") + "`"


def struct_sql(**fields: str) -> str:
    """A struct of SQL expressions as SQL text."""
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def share_sql(part: str, whole: str) -> str:
    """:func:`share` as SQL text."""
    return f"coalesce(try_divide(double({part}), double({whole})), 0.0D)"


def rows_from_sql(structs: Sequence[str]) -> Column:
    """Generator that turns structs, given as SQL text, into rows of one wide row.

    One parsed expression instead of a Column per field keeps building a plan with
    hundreds of expressions fast.
    """
    return F.expr(f"inline(array({', '.join(structs)}))")


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def ratio_or_null(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, NULL when the divisor is NULL or zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def hash_bucket(key: Column, seed: int, buckets: int = 10_000) -> Column:
    """A bucket in ``[0, buckets)`` that depends on the key and seed only.

    Any engine with MD5 can repeat it, and it does not move when the data is
    repartitioned, unlike ``randomSplit``.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def failing_codes(checks: Iterable[tuple[str, Column]]) -> Column:
    """Codes of the checks whose condition does not hold, in order."""
    codes = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(code)) for code, ok in checks]
    return F.array_compact(F.array(*codes))


def all_set(columns: Iterable[str]) -> Column:
    """True when none of the columns is NULL."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition
