"""Table profiles. Every section is a lazy DataFrame; nothing is sampled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.errors import SchemaError
from gaugeworks.functions.columns import name_of, rows_from_sql, share, share_sql, struct_sql, text_literal
from gaugeworks.functions.ordered import top_per_group
from gaugeworks.functions.gram import complete_pairs
from gaugeworks.functions.ranks import FENCE_FACTOR, exact_quantiles, fences, sketched_quantiles
from gaugeworks.operators.rules import ROWS, distinct_keys

QUANTILES = (0.25, 0.5, 0.75)
MAX_CATEGORIES = 50
_DIGITS = 4
# Pairs of columns that are correlated by aggregates; more of them come from one product of vectors.
FEW_PAIRS = 28


@dataclass(frozen=True)
class ProfileSpec:
    """Which columns play which part. ``exact`` asks for exact quantiles."""

    required: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    target: str | None = None
    dates: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    max_categories: int = MAX_CATEGORIES
    quantiles: tuple[float, ...] = QUANTILES
    exact: bool = False


def profile_schema(df: DataFrame) -> DataFrame:
    """Name, type and nullability per field; reads metadata only."""
    fields = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(fields, "position int, column string, type string, nullable boolean")


def _null_aggregates(columns: Sequence[str]) -> list[Column]:
    return [F.expr(f"count_if({name_of(c)} IS NULL) AS nulls{i}") for i, c in enumerate(columns)]


def profile_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count and share per column; NaN is not NULL. An empty table gives no rows."""
    columns = list(df.columns if columns is None else columns)
    row = df.agg(F.count(F.lit(1)).alias(ROWS), *_null_aggregates(columns))
    structs = [
        struct_sql(
            column=text_literal(c),
            row_count=ROWS,
            null_count=f"nulls{i}",
            null_percentage=f"round({share_sql(f'nulls{i}', ROWS)}, {_DIGITS})",
        )
        for i, c in enumerate(columns)
    ]
    return row.select(rows_from_sql(structs)).where(F.col("row_count") > 0)


def profile_duplicates(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first per key; whole rows when no key is given. NULL is one key value."""
    keys = list(keys) or df.columns
    n, distinct = F.col(ROWS), F.col("n_keys")
    return distinct_keys(df, keys).select(
        n.alias("row_count"),
        distinct.alias("distinct_count"),
        (n - distinct).alias("duplicate_count"),
        F.round(share(n - distinct, n), _DIGITS).alias("duplicate_percentage"),
    )


def _numeric_aggregates(columns: Sequence[str]) -> list[Column]:
    functions = {"min": "min", "max": "max", "mean": "avg", "sd": "stddev"}
    return [
        F.expr(f"{function}(double({name_of(c)})) AS {prefix}{i}")
        for i, c in enumerate(columns)
        for prefix, function in functions.items()
    ]


def profile_numeric(
    df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = QUANTILES, exact: bool = False
) -> DataFrame:
    """Min, max, mean, sample deviation, quantiles and median (the middle entry of the quantile list).

    Exact quantiles are computed at once, the approximate form is lazy.
    """
    columns = list(columns)
    aggregates = _numeric_aggregates(columns)
    if not exact:
        aggregates += sketched_quantiles(columns, quantiles)

    def entry(i: int, c: str) -> str:
        fields = {"column": text_literal(c), "min": f"min{i}", "max": f"max{i}", "mean": f"mean{i}", "stddev": f"sd{i}"}
        return struct_sql(**fields, quantiles=f"q{i}")

    if exact:
        found, row = exact_quantiles(df, columns, quantiles, aggregates)
        kinds = "column string, min double, max double, mean double, stddev double"
        stats = [(c, row[f"min{i}"], row[f"max{i}"], row[f"mean{i}"], row[f"sd{i}"]) for i, c in enumerate(columns)]
        # Both sides have one row per profiled column.
        rows = df.sparkSession.createDataFrame(stats, kinds).join(F.broadcast(found), "column")
    else:
        rows = df.agg(*aggregates).select(rows_from_sql([entry(i, c) for i, c in enumerate(columns)]))
    middle = len(quantiles) // 2
    return rows.select(
        "column", "min", "max", "mean", "stddev", F.col("quantiles")[middle].alias("median"), "quantiles"
    )


def profile_quantiles(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(column, share, value): exact quantiles as text in the column's own type.

    For numbers, dates and timestamps; a bigint, decimal or timestamp keeps every
    digit, NaN comes last, and a column without values has NULL. Runs at once.
    """
    found = exact_quantiles(df, columns, quantiles)[0]
    shares = F.array(*[F.lit(float(q)) for q in quantiles])
    return found.select("column", F.explode(F.arrays_zip(shares.alias("share"), F.col("texts"))).alias("e")).select(
        "column", F.col("e.share").alias("share"), F.col("e.texts").alias("value")
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for several columns from one scan; NULL is a value."""
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return as_text.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def profile_categorical(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """The most frequent values per column with the number of distinct values; NULL counts as one.

    Equal counts are ordered by value, NULL last.
    """
    counts = value_counts(df, columns)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    top = top_per_group(
        counts, ["column"], [F.desc("n"), F.asc_nulls_last("value")], max_categories, "position"
    )
    # `distinct` has one row per profiled column.
    return top.join(F.broadcast(distinct), "column").select(
        "column",
        "position",
        "value",
        F.col("n").alias("count"),
        "distinct_count",
        (F.col("distinct_count") > max_categories).alias("high_cardinality"),
    )


def profile_target(df: DataFrame, target: str) -> DataFrame:
    """Class balance of a 0/1 label over all rows, NULL labels included in the total.

    A table without the column gives no rows.
    """
    if target not in df.columns:
        return df.sparkSession.createDataFrame(
            [],
            "total bigint, positives bigint, negatives bigint, positive_ratio double, "
            "negative_ratio double, imbalance_ratio double",
        )
    label = F.col(target)
    row = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(label == 1).alias("positives"),
        F.count_if(label == 0).alias("negatives"),
    )
    return row.select(
        "total",
        "positives",
        "negatives",
        F.round(share(F.col("positives"), F.col("total")), _DIGITS).alias("positive_ratio"),
        F.round(share(F.col("negatives"), F.col("total")), _DIGITS).alias("negative_ratio"),
        F.round(F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")), _DIGITS).alias(
            "imbalance_ratio"
        ),
    )


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """Rows per label value."""
    return df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _correlation_aggregates(pairs: Sequence[tuple[str, str]], nulls_as_zero: bool) -> list[Column]:
    """Covariance and both deviations of each pair, over the rows that have both; no deviation of what is constant there.

    Merging the moments of many tasks rounds, so a constant is told by its least and greatest value.
    """

    def number(c: str) -> str:
        value = f"double({name_of(c)})"
        return f"coalesce({value}, 0.0D)" if nulls_as_zero else value

    found = []
    for i, (a, b) in enumerate(pairs):
        x, y = number(a), number(b)
        found.append(F.expr(f"covar_pop({x}, {y}) AS cov{i}"))
        for name, v, other in (("x", x, y), ("y", y, x)):
            held = f"if({other} IS NULL, NULL, {v})"
            found.append(F.expr(f"if(min({held}) < max({held}), stddev_pop({held}), 0.0D) AS sd{name}{i}"))
    return found


def _correlation(i: int) -> str:
    """From the aggregates of pair ``i``; NULL without two different values on both sides."""
    return f"try_divide(cov{i}, sdx{i} * sdy{i})"


def profile_correlations(df: DataFrame, columns: Sequence[str], nulls_as_zero: bool = False) -> DataFrame:
    """Pearson correlation of every pair, rounded.

    Pairs with a NULL are left out; ``nulls_as_zero`` counts a NULL as 0 instead. A
    column that is constant over the rows of a pair has no correlation (NULL), and
    one with NaN or an infinity there has NaN. The table is read once, however many
    columns there are; of more than ``FEW_PAIRS`` pairs the result is computed at once.
    """
    columns = list(columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    if len(pairs) > FEW_PAIRS:
        return complete_pairs(df, columns, nulls_as_zero).select(
            "column_a", "column_b", F.round("correlation", _DIGITS).alias("correlation")
        )
    structs = [
        struct_sql(column_a=text_literal(a), column_b=text_literal(b), correlation=f"round({_correlation(i)}, {_DIGITS})")
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*_correlation_aggregates(pairs, nulls_as_zero)).select(rows_from_sql(structs))


_OUTLIERS = "column string, q1 double, median double, q3 double, iqr double, lower_bound double, upper_bound double, outlier_count bigint"


def profile_outliers(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Quartiles and median, fences at 1.5 times the quartile distance, and the rows strictly outside.

    A column without values has NULL fences and no outliers; NaN lies above every
    number and so is an outlier. In the approximate form the fences of all columns
    come from one pass and enter the counting pass as a scalar. In the exact form,
    which runs at once, the pass that finds the quartiles also counts.
    """
    columns = list(columns)
    if exact:
        found = exact_quantiles(df, columns, QUANTILES, quartiles=(0, 2))[0].collect()
        return _outlier_rows(df, [(r["column"], r["quantiles"], r["outside"]) for r in found])
    row = df.agg(*sketched_quantiles(columns, QUANTILES))
    by_column = row.select(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"q{i}") for i in range(len(columns))])))
    numbers = [F.expr(f"double({name_of(c)}) AS v{i}") for i, c in enumerate(columns)]
    counted = df.select(*numbers).withColumn("__q", by_column.scalar())

    def bounds(c: str) -> tuple[str, str, str, str]:
        pair = f"try_element_at(__q, {text_literal(c)})"
        q1, q3 = f"{pair}[0]", f"{pair}[2]"
        reach = f"{FENCE_FACTOR}D * ({q3} - {q1})"
        return q1, q3, f"({q1} - {reach})", f"({q3} + {reach})"

    aggregates, structs = [], []
    for i, c in enumerate(columns):
        q1, q3, low, high = bounds(c)
        aggregates.append(F.expr(f"count_if(v{i} < {low} OR v{i} > {high}) AS out{i}"))
        structs.append(
            struct_sql(
                column=text_literal(c),
                q1=q1,
                median=f"try_element_at(__q, {text_literal(c)})[1]",
                q3=q3,
                iqr=f"{q3} - {q1}",
                lower_bound=low,
                upper_bound=high,
                outlier_count=f"out{i}",
            )
        )
    row = counted.agg(*aggregates, F.first("__q").alias("__q"))
    return row.select(rows_from_sql(structs))


def _outlier_rows(df: DataFrame, found: Sequence[tuple[str, Sequence[float | None], int]]) -> DataFrame:
    rows = []
    for column, (q1, median, q3), outside in found:
        low, high = fences(q1, q3)
        rows.append((column, q1, median, q3, None if q1 is None else q3 - q1, low, high, outside))
    return df.sparkSession.createDataFrame(rows, _OUTLIERS)


def month_of(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def profile_temporal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per month, with the first and last value of the column; absent columns are skipped.

    Months are counted in one shuffle for all columns; first and last follow from
    the months, so the table is read once.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [], "column string, month string, n bigint, min_date string, max_date string"
        )
    months = _monthly(df, present)
    ends = months.groupBy("column").agg(
        F.min("first").cast("string").alias("min_date"), F.max("last").cast("string").alias("max_date")
    )
    # `ends` has one row per date column.
    return months.join(F.broadcast(ends), "column").select("column", "month", "n", "min_date", "max_date")


def _monthly(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = {df.schema[c].dataType for c in columns}
    common = next(iter(kinds)).simpleString() if len(kinds) == 1 else "timestamp"
    typed = df.select(*[F.col(c).cast(common).alias(c) for c in columns])
    long = typed.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
    return long.groupBy("column", month_of(F.col("value")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last")
    )


def require_columns(df: DataFrame, required: Sequence[str], purpose: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"{purpose}: missing column(s) {', '.join(missing)}")


def profile(df: DataFrame, spec: ProfileSpec) -> dict[str, DataFrame]:
    """All sections as separate lazy DataFrames."""
    require_columns(df, spec.required, "profile")
    sections = {
        "schema": profile_schema(df),
        "nulls": profile_nulls(df),
        "duplicates": profile_duplicates(df, spec.keys),
        "temporal": profile_temporal(df, spec.dates),
    }
    if spec.numeric:
        sections["numeric"] = profile_numeric(df, spec.numeric, spec.quantiles, spec.exact)
        sections["correlations"] = profile_correlations(df, spec.numeric)
        sections["outliers"] = profile_outliers(df, spec.numeric, spec.exact)
    if spec.categorical:
        sections["categorical"] = profile_categorical(df, spec.categorical, spec.max_categories)
    if spec.target is not None:
        sections["target"] = profile_target(df, spec.target)
        if spec.target in df.columns:
            sections["target_classes"] = target_classes(df, spec.target)
    return sections


def _grouped(df: DataFrame, items: Sequence[tuple[str, Column]]) -> DataFrame:
    """(set, label, n): the rows per value of each item, from one Expand and one shuffle for all; NULL is a value.

    ``set`` is the item's place in the list.
    """
    names = [f"g{k}" for k in range(len(items))]
    found = (
        df.select(*[column.cast("string").alias(name) for name, (_, column) in zip(names, items)])
        .groupingSets([[F.col(name)] for name in names], *names)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    )
    # A bit of the grouping id is set for each column that is not in the set.
    every = (1 << len(names)) - 1
    which = {every & ~(1 << (len(names) - 1 - k)): k for k in range(len(names))}
    place = "CASE gid " + " ".join(f"WHEN {gid} THEN {k}" for gid, k in which.items()) + " END"
    return found.select(F.expr(place).alias("set"), F.coalesce(*names).alias("label"), "n")


def _scalar_aggregates(df: DataFrame, spec: ProfileSpec) -> tuple[list[Column], list[str]]:
    """Nulls, numeric statistics, few correlations and target: the aggregates, and the rows that follow from them as SQL text."""
    names, numeric, pairs = df.columns, list(spec.numeric), list(combinations(spec.numeric, 2))
    has_target = spec.target is not None and spec.target in names
    few = len(pairs) <= FEW_PAIRS
    aggregates = [F.count(F.lit(1)).alias(ROWS), *_null_aggregates(names), *_numeric_aggregates(numeric)]
    if few:
        aggregates += _correlation_aggregates(pairs, False)
    if has_target:
        label = name_of(spec.target)
        aggregates += [F.expr(f"count_if({label} = {v}) AS {alias}") for v, alias in ((1, "positives"), (0, "negatives"))]

    def entry(section: str, column: str, item: str, number: str) -> str:
        return struct_sql(
            section=text_literal(section),
            column=text_literal(column),
            item=text_literal(item),
            number=f"round(double({number}), {_DIGITS})",
        )

    rows = [entry("table", "", "row_count", ROWS), entry("table", "", "column_count", str(len(names)))]
    for i, c in enumerate(names):
        rows.append(entry("nulls", c, "null_count", f"nulls{i}"))
        rows.append(entry("nulls", c, "null_percentage", share_sql(f"nulls{i}", ROWS)))
    for i, c in enumerate(numeric):
        for item, prefix in (("min", "min"), ("max", "max"), ("mean", "mean"), ("stddev", "sd")):
            rows.append(entry("numeric", c, item, f"{prefix}{i}"))
    if few:
        for i, (a, b) in enumerate(pairs):
            rows.append(entry("correlations", a, b, _correlation(i)))
    if has_target:
        rows.append(entry("target", spec.target, "positive_ratio", share_sql("positives", ROWS)))
        rows.append(entry("target", spec.target, "negative_ratio", share_sql("negatives", ROWS)))
        rows.append(entry("target", spec.target, "imbalance_ratio", "try_divide(double(negatives), double(positives))"))
    return aggregates, rows


def profile_report(df: DataFrame, spec: ProfileSpec) -> DataFrame:
    """Every section in one long table (section, column, item, number).

    All scalar statistics share one pass, with exact quantiles the one that
    sketches them, and outliers are counted with the quantiles; these run at once.
    Keys and months are grouping sets of one pass, categories of another, since
    only of these the most frequent are kept.
    """
    require_columns(df, spec.required, "profile")
    spark = df.sparkSession

    def long(rows: DataFrame, section: str, item: Column, number: Column) -> DataFrame:
        return rows.select(
            F.lit(section).alias("section"),
            F.col("column"),
            item.alias("item"),
            F.round(number.cast("double"), _DIGITS).alias("number"),
        )

    def named(columns: Sequence[str]) -> Column:
        return F.expr("CASE set " + " ".join(f"WHEN {k} THEN {text_literal(c)}" for k, c in enumerate(columns)) + " END")

    aggregates, entries = _scalar_aggregates(df, spec)
    outliers = None
    if spec.numeric and spec.exact:
        found, row = exact_quantiles(df, spec.numeric, QUANTILES, aggregates, (0, 2))
        fields = [f for f in df.agg(*aggregates).schema.fields]
        base = spark.createDataFrame([tuple(row[f.name] for f in fields)], StructType(fields))
        outliers = _outlier_rows(df, [(r["column"], r["quantiles"], r["outside"]) for r in found.collect()])
    else:
        base = df.agg(*aggregates)
        if spec.numeric:
            outliers = profile_outliers(df, spec.numeric)
    parts = [base.select(rows_from_sql(entries))]
    if outliers is not None:
        rows = "'numeric', 'p25', q1, 'numeric', 'p50', median, 'numeric', 'p75', q3, 'outliers', 'outlier_count', double(outlier_count)"
        four = outliers.select("column", F.expr(f"stack(4, {rows}) AS (section, item, number)"))
        parts.append(four.withColumn("number", F.round("number", _DIGITS)))
    if len(spec.numeric) * (len(spec.numeric) - 1) // 2 > FEW_PAIRS:
        pairs = profile_correlations(df, spec.numeric).withColumnRenamed("column_a", "column")
        parts.append(long(pairs, "correlations", F.col("column_b"), F.col("correlation")))

    # The key's values are counted as such, a month as its rows.
    keys = list(spec.keys) or df.columns
    present = [c for c in spec.dates if c in df.columns]
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if len(keys) > 1 else F.col(keys[0])
    groups = _grouped(df, [("key", key), *[(c, month_of(F.col(c))) for c in present]])
    counts = groups.where("set = 0 OR label IS NOT NULL").groupBy("set", F.expr("if(set = 0, NULL, label)").alias("month"))
    counts = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    parts.append(
        counts.select(
            F.expr("if(set = 0, 'duplicates', 'temporal')").alias("section"),
            named([",".join(spec.keys), *present]).alias("column"),
            F.expr("if(set = 0, 'duplicate_count', month)").alias("item"),
            F.round(F.expr("double(if(set = 0, n - groups, n))"), _DIGITS).alias("number"),
        )
    )
    if spec.categorical:
        values = _grouped(df, [(c, F.col(c)) for c in spec.categorical])
        top = top_per_group(values, ["set"], [F.desc("n"), F.asc_nulls_last("label")], spec.max_categories, "position")
        parts.append(long(top.withColumn("column", named(spec.categorical)), "categorical", F.col("label"), F.col("n")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
