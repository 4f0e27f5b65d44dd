"""Profile queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import profile as p
from gaugeworks.plans import inputs as i
from gaugeworks.plans.sql import over

SPEC = p.ProfileSpec(
    required=i.REQUIRED,
    numeric=i.NUMERIC,
    categorical=i.CATEGORICAL,
    target="churn",
    dates=("signup_date",),
    keys=("customer_id",),
    exact=True,
)
TYPED_SHARES = (0.001, 0.25, 0.5, 0.75, 0.999)
#: Columns derived alike in Spark and in the oracle, as SQL text.
WIDE = {
    **{c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_partkey")},
    **{f"price_over_{k}": f"CASE WHEN l_linenumber <> {k} THEN l_extendedprice / l_quantity END" for k in (1, 2, 3)},
    "always": "CASE WHEN l_tax >= 0 THEN 7.5 END",
}
PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def profile_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema of the orders table with the NULLs counted per column."""
    df = i.table(spark, sf_dir, "orders")
    return p.profile_schema(df).join(p.profile_nulls(df), "column").select("column", "type", "nullable", "null_count")


def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_nulls(i.churn_dirty(spark, sf_dir))


def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_duplicates(i.churn_dirty(spark, sf_dir), ["customer_id"])


def profile_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_duplicates(i.churn_dirty(spark, sf_dir))


def _numeric(df: DataFrame, columns, exact: bool) -> DataFrame:
    q = F.col("quantiles")
    return p.profile_numeric(df, columns, exact=exact).select(
        "column",
        *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "stddev", "median")],
        *[F.round(q[k], 4).alias(name) for k, name in enumerate(("p25", "p50", "p75"))],
    )


def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric(i.table(spark, sf_dir, "lineitem"), PRICES, exact=True)


def profile_numeric_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column with many NaN, which rank above every number."""
    taxed = F.when(F.col("l_discount") > 0.06, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("taxed")
    return _numeric(i.table(spark, sf_dir, "lineitem").select(taxed), ["taxed"], exact=True).select(
        "column", "min", "median", "p25", F.isnan("p75").alias("p75_is_nan"), F.isnan("max").alias("max_is_nan")
    )


def profile_numeric_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-pass form: its exact statistics, and whether the rank of each quantile is within 1e-3 of the rows."""
    lines = i.table(spark, sf_dir, "lineitem").select(*PRICES)
    found = p.profile_numeric(lines, PRICES, exact=False)
    # One row per column.
    ranked = lines.unpivot([], list(PRICES), "column", "value").join(F.broadcast(found), "column").where("value IS NOT NULL")
    shares = dict(zip(("p25", "p50", "p75"), p.QUANTILES))
    below = [F.count_if(F.col("value") < F.col("quantiles")[k]).alias(f"below{k}") for k in range(3)]
    upto = [F.count_if(F.col("value") <= F.col("quantiles")[k]).alias(f"upto{k}") for k in range(3)]
    row = ranked.groupBy("column", "min", "max", "mean", "stddev").agg(F.count(F.lit(1)).alias("n"), *below, *upto)
    close = [
        ((F.col(f"below{k}") <= (share + 0.001) * F.col("n")) & (F.col(f"upto{k}") >= (share - 0.001) * F.col("n"))).alias(f"{name}_close")
        for k, (name, share) in enumerate(shares.items())
    ]
    return row.select("column", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "stddev")], *close)


def profile_quantiles_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles in the type of the column: numbers above 2^53, decimals and times keep every digit."""
    lines = i.table(spark, sf_dir, "lineitem").select(
        F.expr("bigint(l_orderkey) * 1000000000039 + l_linenumber AS line_code"),
        F.expr("CAST(l_extendedprice AS DECIMAL(20,2)) * CAST(1000000000000001 AS DECIMAL(16,0)) AS scaled"),
        F.col("l_shipdate").alias("shipped"),
    )
    found = p.profile_quantiles(lines, lines.columns, TYPED_SHARES)
    return found.select("column", F.concat(F.lit("p"), (F.col("share") * 1000).cast("int")).alias("quantile"), "value")


def profile_correlations_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of many columns, some with NULLs, from one product of vectors."""
    return p.profile_correlations(_wide(i.table(spark, sf_dir, "lineitem")), list(WIDE))


def _wide(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(*[f"{sql} AS {name}" for name, sql in WIDE.items()])


def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = i.churn_dirty(spark, sf_dir)
    return p.profile_categorical(df, [*i.CATEGORICAL, "tenure_months"], 10).withColumn(
        "position", F.col("position").cast("bigint")
    )


def profile_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_target(i.churn_dirty(spark, sf_dir), "churn")


def target_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.target_classes(i.churn_dirty(spark, sf_dir), "churn")


def profile_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_correlations(i.churn_dirty(spark, sf_dir), i.NUMERIC)


def profile_correlations_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_correlations(i.churn_dirty(spark, sf_dir), i.NUMERIC, nulls_as_zero=True)


def profile_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    outliers = p.profile_outliers(i.churn_dirty(spark, sf_dir), i.NUMERIC, exact=True)
    rounded = ("q1", "q3", "iqr", "lower_bound", "upper_bound")
    return outliers.select("column", *[F.round(c, 4).alias(c) for c in rounded], "outlier_count")


def profile_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_temporal(i.table(spark, sf_dir, "orders"), ["o_orderdate", "no_such_column"])


def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_report(i.churn_dirty(spark, sf_dir), SPEC)


QUERIES = {
    f.__name__: f
    for f in (
        profile_schema,
        profile_nulls,
        profile_duplicates,
        profile_duplicate_rows,
        profile_numeric,
        profile_numeric_nan,
        profile_numeric_approx,
        profile_quantiles_typed,
        profile_correlations_wide,
        profile_categorical,
        profile_target,
        target_classes,
        profile_correlations,
        profile_correlations_zero,
        profile_outliers,
        profile_temporal,
        profile_report,
    )
}


def _all(parts) -> str:
    return "\nUNION ALL ".join(parts)


_ORDERS = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


def _nulls(c: str, table: str = "churn_dirty") -> str:
    return (
        f"SELECT '{c}' AS \"column\", COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, "
        f"ROUND(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) AS null_percentage FROM {table}"
    )


def _numeric_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", ROUND(MIN({c}), 4) AS \"min\", ROUND(MAX({c}), 4) AS \"max\", "
        f"ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS stddev, "
        f"ROUND(QUANTILE_DISC({c}, 0.5), 4) AS median, ROUND(QUANTILE_DISC({c}, 0.25), 4) AS p25, "
        f"ROUND(QUANTILE_DISC({c}, 0.5), 4) AS p50, ROUND(QUANTILE_DISC({c}, 0.75), 4) AS p75 FROM lineitem"
    )


def _top(c: str, n: int) -> str:
    return (
        f"SELECT '{c}' AS \"column\", position, value, n AS count, distinct_count, distinct_count > {n} AS high_cardinality "
        f"FROM (SELECT CAST({c} AS VARCHAR) AS value, COUNT(*) AS n, COUNT(*) OVER () AS distinct_count, "
        f"ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) ASC NULLS LAST) AS position "
        f"FROM churn_dirty GROUP BY {c}) t WHERE position <= {n}"
    )


def _corr(a: str, b: str, zero: bool) -> str:
    x, y = (f"COALESCE({c}, 0)" if zero else c for c in (a, b))
    return f"SELECT '{a}' AS column_a, '{b}' AS column_b, ROUND(CORR({x}, {y}), 4) AS correlation FROM churn_dirty"


def _fences(c: str) -> str:
    return (
        f"(SELECT CAST(QUANTILE_DISC({c}, 0.25) AS DOUBLE) AS q1, CAST(QUANTILE_DISC({c}, 0.75) AS DOUBLE) AS q3 "
        "FROM churn_dirty) f"
    )


def _outliers(c: str) -> str:
    low, high = "(f.q1 - 1.5 * (f.q3 - f.q1))", "(f.q3 + 1.5 * (f.q3 - f.q1))"
    return (
        f"SELECT '{c}' AS \"column\", ROUND(f.q1, 4) AS q1, ROUND(f.q3, 4) AS q3, ROUND(f.q3 - f.q1, 4) AS iqr, "
        f"ROUND({low}, 4) AS lower_bound, ROUND({high}, 4) AS upper_bound, "
        f"(SELECT COUNT(*) FROM churn_dirty WHERE {c} < {low} OR {c} > {high}) AS outlier_count FROM {_fences(c)}"
    )


_TARGET = """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE churn = 1) AS positives, COUNT(*) FILTER (WHERE churn = 0) AS negatives,
  ROUND(CAST(COUNT(*) FILTER (WHERE churn = 1) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) AS positive_ratio,
  ROUND(CAST(COUNT(*) FILTER (WHERE churn = 0) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) AS negative_ratio,
  ROUND(CAST(COUNT(*) FILTER (WHERE churn = 0) AS DOUBLE) / CAST(COUNT(*) FILTER (WHERE churn = 1) AS DOUBLE), 4) AS imbalance_ratio
FROM churn_dirty
"""


def _report_sql() -> str:
    def row(section: str, column: str, item: str, number: str, source: str = "churn_dirty") -> str:
        return (
            f"SELECT '{section}' AS section, '{column}' AS \"column\", {item} AS item, "
            f"ROUND(CAST({number} AS DOUBLE), 4) AS number FROM {source}"
        )

    rows = [
        row("table", "", "'row_count'", "COUNT(*)"),
        row("table", "", "'column_count'", str(len(i.REQUIRED)), "(SELECT 1) one"),
        row("duplicates", "customer_id", "'duplicate_count'", "COUNT(*) - COUNT(DISTINCT customer_id)"),
    ]
    for c in i.REQUIRED:
        rows.append(row("nulls", c, "'null_count'", f"COUNT(*) - COUNT({c})"))
        share = f"CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)"
        rows.append(row("nulls", c, "'null_percentage'", share))
    for c in i.NUMERIC:
        for item, f in (("min", "MIN"), ("max", "MAX"), ("mean", "AVG"), ("stddev", "STDDEV_SAMP")):
            rows.append(row("numeric", c, f"'{item}'", f"{f}({c})"))
        for q in (25, 50, 75):
            rows.append(row("numeric", c, f"'p{q}'", f"QUANTILE_DISC({c}, {q / 100})"))
        rows.append(row("outliers", c, "'outlier_count'", "outlier_count", f"({_outliers(c)}) o"))
    for a, b in combinations(i.NUMERIC, 2):
        rows.append(row("correlations", a, f"'{b}'", "correlation", f"({_corr(a, b, False)}) c"))
    for item in ("positive_ratio", "negative_ratio", "imbalance_ratio"):
        rows.append(row("target", "churn", f"'{item}'", item, f"({_TARGET}) t"))
    for c in i.CATEGORICAL:
        rows.append(row("categorical", c, "value", "count", f"({_top(c, 50)}) v"))
    months = "(SELECT STRFTIME(signup_date, '%Y-%m') AS m, COUNT(*) AS n FROM churn_dirty WHERE signup_date IS NOT NULL GROUP BY 1) d"
    rows.append(row("temporal", "signup_date", "m", "n", months))
    return _all(rows)


ORACLES = {
    "profile_schema": _all(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, TRUE AS nullable, COUNT(*) - COUNT({c}) AS null_count FROM orders"
        for c, t in _ORDERS.items()
    ),
    "profile_nulls": over("churn_dirty", _all(_nulls(c) for c in i.REQUIRED)),
    "profile_duplicates": over(
        "churn_dirty",
        "SELECT COUNT(*) AS row_count, COUNT(DISTINCT customer_id) AS distinct_count, "
        "COUNT(*) - COUNT(DISTINCT customer_id) AS duplicate_count, "
        "ROUND(CAST(COUNT(*) - COUNT(DISTINCT customer_id) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) "
        "AS duplicate_percentage FROM churn_dirty",
    ),
    "profile_duplicate_rows": over(
        "churn_dirty",
        "SELECT n AS row_count, d AS distinct_count, n - d AS duplicate_count, "
        "ROUND(CAST(n - d AS DOUBLE) / CAST(n AS DOUBLE), 4) AS duplicate_percentage FROM "
        "(SELECT (SELECT COUNT(*) FROM churn_dirty) AS n, "
        "(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM churn_dirty) x) AS d) t",
    ),
    "profile_numeric": _all(_numeric_sql(c) for c in PRICES),
    "profile_numeric_approx": "SELECT *, TRUE AS p25_close, TRUE AS p50_close, TRUE AS p75_close FROM ("
    + _all(_numeric_sql(c).split(", ROUND(QUANTILE_DISC")[0] + " FROM lineitem" for c in PRICES)
    + ") t",
    "profile_numeric_nan": "SELECT 'taxed' AS \"column\", ROUND(MIN(v), 4) AS \"min\", ROUND(QUANTILE_DISC(v, 0.5), 4) AS median, "
    "ROUND(QUANTILE_DISC(v, 0.25), 4) AS p25, ISNAN(QUANTILE_DISC(v, 0.75)) AS p75_is_nan, ISNAN(MAX(v)) AS max_is_nan "
    "FROM (SELECT CASE WHEN l_discount > 0.06 THEN CAST('nan' AS DOUBLE) ELSE l_tax END AS v FROM lineitem) t",
    "profile_quantiles_typed": _all(
        f"SELECT '{c}' AS \"column\", 'p{int(q * 1000)}' AS quantile, CAST(QUANTILE_DISC({v}, {q}) AS VARCHAR) AS value FROM lineitem"
        for c, v in (
            ("line_code", "CAST(l_orderkey AS BIGINT) * 1000000000039 + l_linenumber"),
            ("scaled", "CAST(l_extendedprice AS DECIMAL(20,2)) * CAST(1000000000000001 AS DECIMAL(16,0))"),
            ("shipped", "l_shipdate"),
        )
        for q in TYPED_SHARES
    ),
    "profile_correlations_wide": "WITH wide AS (SELECT "
    + ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in WIDE.items())
    + " FROM lineitem) "
    + _all(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN '{a}' = 'always' OR '{b}' = 'always' THEN NULL ELSE ROUND(CORR({a}, {b}), 4) END AS correlation FROM wide"
        for a, b in combinations(WIDE, 2)
    ),
    "profile_categorical": over("churn_dirty", _all(_top(c, 10) for c in (*i.CATEGORICAL, "tenure_months"))),
    "profile_target": over("churn_dirty", _TARGET),
    "target_classes": over("churn_dirty", "SELECT churn AS label, COUNT(*) AS n FROM churn_dirty GROUP BY churn"),
    "profile_correlations": over("churn_dirty", _all(_corr(a, b, False) for a, b in combinations(i.NUMERIC, 2))),
    "profile_correlations_zero": over("churn_dirty", _all(_corr(a, b, True) for a, b in combinations(i.NUMERIC, 2))),
    "profile_outliers": over("churn_dirty", _all(_outliers(c) for c in i.NUMERIC)),
    "profile_temporal": "SELECT 'o_orderdate' AS \"column\", STRFTIME(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n, "
    "(SELECT STRFTIME(MIN(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders) AS min_date, "
    "(SELECT STRFTIME(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders) AS max_date FROM orders GROUP BY 2",
    "profile_report": over("churn_dirty", _report_sql()),
}
