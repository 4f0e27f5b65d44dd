"""Rule, suite, gate and drift queries."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gaugeworks.operators import rules as r
from gaugeworks.operators import suite as s
from gaugeworks.operators.drift import mean_shift
from gaugeworks.operators.sketches import distinct_sketches, merged_sketches
from gaugeworks.plans import inputs as i
from gaugeworks.plans.sql import over
from gaugeworks.sources.readers import schema_problems
from gaugeworks.sources.writers import write_report
from gaugeworks.workspace import fresh_path

RANGES = {"tenure_months": (0, 600), "monthly_charges": (0, 100_000)}
DOMAINS = {"contract_type": i.CONTRACTS, "internet_service": i.SERVICES}


def standard_suite(df: DataFrame, previous_rows=None, reference_schema: StructType | None = None) -> s.QualitySuite:
    """The rules of the churn table with the base limits."""
    return s.table_suite(
        df.schema,
        required=i.REQUIRED,
        key="customer_id",
        domains=DOMAINS,
        ranges=RANGES,
        target="churn",
        previous_rows=previous_rows,
        reference_schema=reference_schema,
        min_rows=50,
        max_rows=5_000_000_000,
    )


def _verdicts(results: DataFrame) -> DataFrame:
    return results.select("rule", "severity", "status", F.col("observed_num").alias("observed"))


def _single(rule_of):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = i.churn_dirty(spark, sf_dir)
        return _verdicts(s.QualitySuite([rule_of(spark, sf_dir)]).evaluate(df))

    return query


def quality_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = i.churn_dirty(spark, sf_dir)
    previous = i.churn(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return _verdicts(standard_suite(df, previous).evaluate(df))


def quality_failed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = i.churn_dirty(spark, sf_dir)
    failed = s.failed_rules(standard_suite(df).evaluate(df))
    return failed.select("rule", "severity", "blocking", F.col("observed_num").alias("observed"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the clean and the dirty table, gated from their rule rows and summaries."""
    rules = None
    for run, df in (("clean", i.churn(spark, sf_dir)), ("dirty", i.churn_dirty(spark, sf_dir))):
        part = standard_suite(df).evaluate(df).withColumn("run_id", F.lit(run))
        rules = part if rules is None else rules.unionByName(part)
    # The gate reads stored rows, as it does in a job of its own; each suite runs once.
    path = fresh_path(spark, "rule-rows")
    rules.write.parquet(path)
    rules = spark.read.schema(rules.schema).parquet(path)
    return s.gate_reports(rules, s.summarize(rules, ["run_id"]))


def quality_volume_from_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts against the last stored run: two runs are reported, the third is compared with the later one."""
    path = fresh_path(spark, "reports")
    runs = ("2024-01-01 00:00:00", i.churn(spark, sf_dir)), ("2024-01-02 00:00:00", i.churn(spark, sf_dir).where("is_active"))
    for day, df in runs:
        rows = s.QualitySuite([r.row_count(1, 5_000_000_000)]).evaluate(df, F.lit(day).cast("timestamp"))
        write_report(rows.select("rule", "status", "row_count", "evaluated_at"), path, day[:10])
    previous = s.previous_row_count(spark.read.parquet(path), "evaluated_at")
    today = s.QualitySuite([r.volume_change(previous, 0.1), r.volume_change(None, 0.1)])
    found = today.evaluate(i.churn_dirty(spark, sf_dir), F.lit("2024-01-03 00:00:00").cast("timestamp"))
    return found.select(
        "rule", "severity", "status", F.col("observed_num").alias("observed"), F.date_format("evaluated_at", "yyyy-MM-dd").alias("day")
    )


def rule_referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = i.table(spark, sf_dir, "part").where(F.col("p_size") > 2)
    rule = r.referential_integrity("l_partkey", parts, "p_partkey")
    return _verdicts(s.QualitySuite([rule]).evaluate(i.table(spark, sf_dir, "lineitem")))


def rule_domain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = i.table(spark, sf_dir, "part").where(F.col("p_size") > 2)
    rule = r.allowed_domain_table("l_partkey", parts, "p_partkey")
    return _verdicts(s.QualitySuite([rule]).evaluate(i.table(spark, sf_dir, "lineitem")))


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table against a registered schema in which one type and one field differ."""
    df = i.churn_dirty(spark, sf_dir)
    fields = [
        StructField(f.name, IntegerType() if f.name == "total_charges" else f.dataType, f.nullable)
        for f in df.schema.fields
        if f.name != "is_active"
    ]
    suite = s.QualitySuite([r.row_count(50, 5_000_000_000), r.schema_drift(df.schema, StructType(fields))])
    return suite.evaluate(df).select("rule", "status", "observed", "row_count")


def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a wanted schema that lineitem lacks or types otherwise, next to the rows checked."""
    df = i.table(spark, sf_dir, "lineitem")
    wanted = StructType(
        [
            df.schema["l_orderkey"],
            StructField("l_linenumber", df.schema["l_orderkey"].dataType),
            StructField("l_comment", df.schema["l_returnflag"].dataType),
        ]
    )
    problems = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.lit(want).alias("expected"), F.lit(have or "absent").alias("actual"))
            for n, want, have in schema_problems(df.schema, wanted)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(problems), "row_count")


def data_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned against accepted line items."""
    lines = i.table(spark, sf_dir, "lineitem")
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    drift = mean_shift(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), columns)
    return drift.select(
        "column",
        *[F.round(c, 4).alias(c) for c in ("current_mean", "reference_mean", "current_stddev", "reference_stddev")],
        "relative_mean_shift",
    )


def quality_suite_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the same kind on the same column, each with its own verdict."""
    lines, parts = i.table(spark, sf_dir, "lineitem"), i.table(spark, sf_dir, "part")
    sizes = [parts.where(F.col("p_size") > k).agg(F.count(F.lit(1))).scalar() for k in (0, 40)]
    return _verdicts(
        s.QualitySuite(
            [
                r.allowed_domain("l_returnflag", ["A", "N", "R", None]),
                r.allowed_domain("l_returnflag", ["A", "R"]),
                r.value_range("l_shipdate", dt.datetime(1990, 1, 1), None),
                r.value_range("l_shipdate", dt.date(1996, 1, 1), dt.date(1997, 1, 1)),
                r.value_range("l_tax", None, Decimal("0.05")),
                r.value_range("l_tax", 0, float("inf")),
                r.referential_integrity("l_partkey", parts, "p_partkey"),
                r.referential_integrity("l_partkey", parts, "p_size"),
                r.allowed_domain_table("l_partkey", parts, "p_partkey"),
                r.allowed_domain_table("l_partkey", parts, "p_size"),
                r.volume_change(sizes[0], 0.5),
                r.volume_change(sizes[1], 0.5),
            ]
        ).evaluate(lines)
    )


def distinct_sketches_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of all days from one stored sketch a day, two of them written again, and how near they are to the exact counts."""
    events = i.table(spark, sf_dir, "events")
    path, sets = fresh_path(spark, "sketches"), (("user_id",), ("user_id", "event_type"), ("event_id",))
    day = F.date_format("ts", "yyyy-MM-dd")
    last = events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).scalar()
    for rows in (events.where(day < last), events.where(day >= F.date_format(F.date_sub(F.to_date(last), 1), "yyyy-MM-dd"))):
        # The parts that a run writes replace those of its days, and no others.
        distinct_sketches(rows, sets, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "part"
        ).parquet(path)
    found = merged_sketches(spark.read.parquet(path))
    counts = [
        r.distinct_keys(events, keys).select(F.lit(",".join(keys)).alias("keys"), F.col("n_keys").alias("exact")) for keys in sets
    ]
    exact = counts[0].unionByName(counts[1]).unionByName(counts[2])
    near = (F.abs(F.col("n_keys") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near")
    return found.join(exact, "keys").select("keys", F.col(r.ROWS).alias("n_rows"), "exact", near)


QUERIES = {
    "distinct_sketches_daily": distinct_sketches_daily,
    "quality_suite": quality_suite,
    "quality_suite_repeated": quality_suite_repeated,
    "quality_volume_from_report": quality_volume_from_report,
    "quality_failed_rules": quality_failed_rules,
    "quality_gate": quality_gate,
    "rule_row_count": _single(lambda spark, d: r.row_count(50, 1_000)),
    "rule_volume_change": _single(
        lambda spark, d: r.volume_change(i.churn(spark, d).where("is_active").agg(F.count(F.lit(1))).scalar(), 0.5)
    ),
    "rule_null_percentage": _single(lambda spark, d: r.null_percentage("support_calls", 0.05)),
    "rule_duplicates": _single(lambda spark, d: r.duplicates(["customer_id"], 0.01)),
    "rule_value_range": _single(lambda spark, d: r.value_range("monthly_charges", 0, 100_000)),
    "rule_allowed_domain": _single(lambda spark, d: r.allowed_domain("contract_type", i.CONTRACTS)),
    "rule_allowed_domain_table": rule_domain_table,
    "rule_cardinality": _single(lambda spark, d: r.cardinality("contract_type", 4)),
    "rule_target_distribution": _single(lambda spark, d: r.target_distribution("churn")),
    "rule_referential_integrity": rule_referential_integrity,
    "schema_drift": schema_drift,
    "schema_validate": schema_validate,
    "data_drift": data_drift,
}

_N = "CAST(COUNT(*) AS DOUBLE)"


def _rule(rule: str, severity: str, observed: str, passed: str, table: str = "churn_dirty") -> str:
    """One verdict row: ``passed`` is a condition on ``x``, the unrounded observed value."""
    return (
        f"SELECT '{rule}' AS rule, '{severity}' AS severity, CASE WHEN {passed} THEN 'pass' ELSE 'fail' END AS status, "
        f"ROUND(CAST(x AS DOUBLE), 4) AS observed FROM (SELECT {observed} AS x FROM {table}) q"
    )


def _null(column: str) -> str:
    observed = f"CAST(SUM(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / {_N}"
    return _rule(f"null_percentage[{column}]", "error", observed, "x <= 0.05")


def _range(column: str, low: int, high: int) -> str:
    observed = f"SUM(CASE WHEN {column} < {low} OR {column} > {high} THEN 1 ELSE 0 END)"
    return _rule(f"value_range[{column}]", "error", observed, "x = 0")


def _domain(column: str, values: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    observed = f"SUM(CASE WHEN {column} IS NOT NULL AND {column} NOT IN ({listed}) THEN 1 ELSE 0 END)"
    return _rule(f"allowed_domain[{column}]", "error", observed, "x = 0")


_DUPLICATES = _rule(
    "duplicates[customer_id]", "error", f"CAST(COUNT(*) - COUNT(DISTINCT customer_id) AS DOUBLE) / {_N}", "x <= 0.01"
)
_TARGET = _rule(
    "target_distribution[churn]",
    "warning",
    f"CAST(SUM(CASE WHEN churn = 1 THEN 1 ELSE 0 END) AS DOUBLE) / {_N}",
    "x >= 0.01 AND x <= 0.99",
)


def suite_sql(volume: str) -> str:
    rows = [
        "SELECT 'required_columns' AS rule, 'critical' AS severity, 'pass' AS status, CAST(0 AS DOUBLE) AS observed",
        "SELECT 'extra_columns', 'warning', 'pass', CAST(0 AS DOUBLE)",
        _rule("row_count", "critical", "COUNT(*)", "x >= 50 AND x <= 5000000000"),
        volume,
        _DUPLICATES,
        *[_null(c) for c in i.REQUIRED],
        *[_domain(c, v) for c, v in DOMAINS.items()],
        *[_range(c, *bounds) for c, bounds in RANGES.items()],
        _TARGET,
    ]
    return "\nUNION ALL ".join(rows)


NO_BASELINE = _rule("volume_change", "info", "COUNT(*)", "x >= 0")


def _volume(previous: str) -> str:
    observed = f"CAST(ABS(COUNT(*) - ({previous})) AS DOUBLE) / ({previous})"
    return _rule("volume_change", "warning", observed, "x <= 0.5")


_ORPHANS = (
    "(SELECT DISTINCT l_partkey FROM lineitem WHERE NOT EXISTS "
    "(SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 2))"
)
_OFF_DOMAIN = "(SELECT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2))"


def _drift_sql() -> str:
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        parts.append(
            f"SELECT '{c}' AS \"column\", ROUND(a.m, 4) AS current_mean, ROUND(b.m, 4) AS reference_mean, "
            f"ROUND(a.s, 4) AS current_stddev, ROUND(b.s, 4) AS reference_stddev, "
            f"ROUND(ABS(a.m - b.m) / ABS(b.m), 4) AS relative_mean_shift "
            f"FROM (SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM lineitem WHERE l_returnflag = 'A') a, "
            f"(SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM lineitem WHERE l_returnflag = 'R') b"
        )
    return "\nUNION ALL ".join(parts)


_GATE_RUN = """
SELECT '{run}' AS run_id, (SELECT COUNT(*) FROM {table}) AS row_count, COUNT(*) AS n_blocking, COUNT(*) = 0 AS gate_passed
FROM ({suite}) v WHERE status = 'fail' AND severity IN ('error', 'critical')
"""

_LINES = "lineitem"


def _off(condition: str) -> str:
    return f"COUNT(*) FILTER (WHERE {condition})"


def _known(column: str, distinct: bool) -> str:
    rows = "COUNT(DISTINCT l_partkey)" if distinct else "COUNT(*)"
    return f"{rows} FILTER (WHERE l_partkey NOT IN (SELECT {column} FROM part))"


def _grown(size: int) -> str:
    before = f"(SELECT COUNT(*) FROM part WHERE p_size > {size})"
    return _rule("volume_change", "warning", f"CAST(ABS(COUNT(*) - {before}) AS DOUBLE) / {before}", "x <= 0.5", _LINES)


_REPEATED = "\nUNION ALL ".join(
    [
        *[
            _rule("allowed_domain[l_returnflag]", "error", _off(f"l_returnflag NOT IN ({known})"), "x = 0", _LINES)
            for known in ("'A', 'N', 'R'", "'A', 'R'")
        ],
        *[
            _rule(f"value_range[{c}]", "error", _off(condition), "x = 0", _LINES)
            for c, condition in (
                ("l_shipdate", "l_shipdate < TIMESTAMP '1990-01-01'"),
                ("l_shipdate", "l_shipdate < DATE '1996-01-01' OR l_shipdate > DATE '1997-01-01'"),
                ("l_tax", "l_tax > 0.05"),
                ("l_tax", "l_tax < 0"),
            )
        ],
        *[
            _rule(f"{rule}[l_partkey]", "error", _known(c, distinct), "x = 0", _LINES)
            for rule, distinct in (("referential_integrity", True), ("allowed_domain", False))
            for c in ("p_partkey", "p_size")
        ],
        _grown(0),
        _grown(40),
    ]
)

ORACLES = {
    "distinct_sketches_daily": "SELECT 'user_id' AS keys, COUNT(*) AS n_rows, COUNT(DISTINCT user_id) AS exact, TRUE AS near FROM events "
    "UNION ALL SELECT 'user_id,event_type', COUNT(*), (SELECT COUNT(*) FROM (SELECT DISTINCT user_id, event_type FROM events) d), TRUE FROM events "
    "UNION ALL SELECT 'event_id', COUNT(*), COUNT(DISTINCT event_id), TRUE FROM events",
    "quality_suite_repeated": _REPEATED,
    "quality_volume_from_report": over(
        "churn_dirty",
        "SELECT v.*, '2024-01-03' AS day FROM ("
        + _volume("SELECT COUNT(*) FROM churn WHERE is_active").replace("x <= 0.5", "x <= 0.1")
        + " UNION ALL "
        + NO_BASELINE
        + ") v",
    ),
    "quality_suite": over("churn_dirty", suite_sql(_volume("SELECT COUNT(*) FROM churn"))),
    "quality_failed_rules": over(
        "churn_dirty",
        "SELECT rule, severity, severity IN ('error', 'critical') AS blocking, observed FROM "
        f"({suite_sql(NO_BASELINE)}) v WHERE status = 'fail'",
    ),
    "quality_gate": over(
        "churn_dirty",
        _GATE_RUN.format(run="dirty", table="churn_dirty", suite=suite_sql(NO_BASELINE))
        + " UNION ALL "
        + _GATE_RUN.format(
            run="clean", table="churn", suite=suite_sql(NO_BASELINE).replace("FROM churn_dirty", "FROM churn")
        ),
    ),
    "rule_row_count": over("churn_dirty", _rule("row_count", "critical", "COUNT(*)", "x BETWEEN 50 AND 1000")),
    "rule_volume_change": over("churn_dirty", _volume("SELECT COUNT(*) FROM churn WHERE is_active")),
    "rule_null_percentage": over("churn_dirty", _null("support_calls")),
    "rule_duplicates": over("churn_dirty", _DUPLICATES),
    "rule_value_range": over("churn_dirty", _range("monthly_charges", 0, 100_000)),
    "rule_allowed_domain": over("churn_dirty", _domain("contract_type", i.CONTRACTS)),
    "rule_allowed_domain_table": _rule("allowed_domain[l_partkey]", "error", "COUNT(*)", "x = 0", _OFF_DOMAIN + " o"),
    "rule_cardinality": over(
        "churn_dirty",
        _rule(
            "cardinality[contract_type]",
            "warning",
            "COUNT(*)",
            "x <= 4",
            "(SELECT DISTINCT contract_type FROM churn_dirty) d",
        ),
    ),
    "rule_target_distribution": over("churn_dirty", _TARGET),
    "rule_referential_integrity": _rule(
        "referential_integrity[l_partkey]", "error", "COUNT(*)", "x = 0", _ORPHANS + " o"
    ),
    "schema_drift": over(
        "churn_dirty",
        "SELECT 'row_count' AS rule, 'pass' AS status, CAST(COUNT(*) AS VARCHAR) AS observed, COUNT(*) AS row_count "
        "FROM churn_dirty UNION ALL SELECT 'schema_drift', 'fail', 'total_charges: type; is_active: added', COUNT(*) "
        "FROM churn_dirty",
    ).replace("'pass' AS status", "CASE WHEN COUNT(*) >= 50 THEN 'pass' ELSE 'fail' END AS status"),
    "schema_validate": "SELECT 'l_linenumber' AS field, 'bigint' AS expected, 'int' AS actual, COUNT(*) AS row_count "
    "FROM lineitem UNION ALL SELECT 'l_comment', 'string', 'absent', COUNT(*) FROM lineitem",
    "data_drift": _drift_sql(),
}
