"""Input frames of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.columns import struct_sql
from gaugeworks.sources.readers import read_parquet

REQUIRED = (
    "customer_id",
    "tenure_months",
    "monthly_charges",
    "total_charges",
    "contract_type",
    "internet_service",
    "support_calls",
    "is_active",
    "signup_date",
    "churn",
)
NUMERIC = ("tenure_months", "monthly_charges", "total_charges", "support_calls")
CATEGORICAL = ("contract_type", "internet_service")
CONTRACTS = ("month-to-month", "one-year", "two-year")
SERVICES = ("dsl", "fiber", "none")

# A customer counts as active when the last order is not older than this.
ACTIVE_SINCE = "2001-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with order history as tenure, charges and support calls."""
    history = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.expr("min(o_orderdate) AS first_dt"),
            F.expr("max(o_orderdate) AS last_dt"),
            F.expr("sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total"),
            F.expr("count_if(startswith(o_orderpriority, '1')) AS urgent"),
        )
    )
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = customers.join(nations, F.expr("c_nationkey = n_nationkey"), "left").join(
        history, F.expr("c_custkey = o_custkey"), "left"
    )
    active = f"coalesce(last_dt >= TIMESTAMP_NTZ '{ACTIVE_SINCE}', false)"
    return joined.selectExpr(
        "string(c_custkey) AS customer_id",
        "int(coalesce((year(last_dt) - year(first_dt)) * 12 + month(last_dt) - month(first_dt), 0)) AS tenure_months",
        "c_acctbal AS monthly_charges",
        "double(total) AS total_charges",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'month-to-month' "
        "WHEN c_mktsegment = 'AUTOMOBILE' THEN 'one-year' ELSE 'two-year' END AS contract_type",
        "CASE WHEN n_regionkey IN (0, 1) THEN 'dsl' WHEN n_regionkey IN (2, 3) THEN 'fiber' ELSE 'none' END "
        "AS internet_service",
        "int(urgent) AS support_calls",
        f"{active} AS is_active",
        "date(first_dt) AS signup_date",
        f"int(if({active}, 0, 1)) AS churn",
    )


def churn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``churn`` with NULLs, a value off the domain and repeated customers.

    Every fiftieth customer comes twice, spoiled and as it was.
    """
    number = "int(customer_id)"
    spoiled = {
        "total_charges": f"if({number} % 13 = 0, NULL, total_charges)",
        "contract_type": f"CASE WHEN {number} % 97 = 0 THEN 'weekly' WHEN {number} % 89 = 0 THEN NULL ELSE contract_type END",
        "support_calls": f"if({number} % 7 = 0, NULL, support_calls)",
    }
    clean_row = struct_sql(**{c: c for c in REQUIRED})
    spoiled_row = struct_sql(**{c: spoiled.get(c, c) for c in REQUIRED})
    return churn(spark, sf_dir).selectExpr(
        f"inline(if({number} % 50 = 0, array({spoiled_row}, {clean_row}), array({spoiled_row})))"
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a prediction and score that follow the tenure; some predictions are missing."""
    return churn(spark, sf_dir).selectExpr(
        "customer_id",
        "churn AS label",
        "CASE WHEN int(customer_id) % 101 = 0 THEN NULL WHEN tenure_months < 66 THEN 1.0D ELSE 0.0D END AS prediction",
        "double(78 - tenure_months) / 78.0D AS score",
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of one model per supplier and one version per return flag; A is champion, R challenger."""
    parts = {
        "accuracy": "l_linestatus = 'F'",
        "precision": "l_quantity > 24",
        "recall": "l_discount >= 0.045D",
        "roc_auc": "l_tax >= 0.035D",
    }
    grouped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("model_id"), F.col("l_returnflag").alias("model_version"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.expr(f"double(count_if({c})) / double(count(1)) AS {name}") for name, c in parts.items()],
        )
    )
    f1 = F.expr("try_divide(2.0D * precision * recall, precision + recall)")
    return grouped.withColumn("f1_score", f1).where("NOT (model_version = 'A' AND model_id % 10 = 0)")


def promotion_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation, run and approval records per model, some of them contradicting."""
    run = "concat('run-', model_id)"
    return (
        model_metrics(spark, sf_dir)
        .select("model_id")
        .distinct()
        .selectExpr(
            "model_id",
            "'R' AS rec_version",
            "if(model_id % 7 = 0, 'N', 'R') AS run_version",
            f"{run} AS rec_run_id",
            f"if(model_id % 5 = 0, 'other', {run}) AS run_run_id",
            "'c0ffee' AS rec_commit",
            "if(model_id % 9 = 0, 'deadbe', 'c0ffee') AS run_commit",
            "if(model_id % 11 = 0, NULL, 'approver-1') AS approver",
            "'R' AS approval_version",
            f"{run} AS approval_run_id",
        )
    )


def alias_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups stand for registrations, purchases for promotions, errors for rollbacks of twenty models."""
    return (
        table(spark, sf_dir, "events")
        .where("event_type IN ('signup', 'purchase', 'error')")
        .selectExpr(
            "event_id",
            "ts",
            "user_id AS model_id",
            "CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'promote' ELSE 'rollback' END AS action",
            "event_id % 40 AS version",
        )
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a customer table with inserts, updates and deletes between them."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    digit = F.col("c_custkey") % 10
    balance = F.when(digit == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return rows.where(digit != 0), rows.where(digit != 1).withColumn("c_acctbal", balance)
