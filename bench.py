"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated keys), BENCH_RUNS (timed runs after one warm-up,
default 1). With BENCH_COMPARE=1 the quality suite and the profile are also
timed in the one-action-per-check style, next to the compiled form, on the same
stored table; those numbers go into "compare".
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.plans import catalog
from gaugeworks.plans import inputs as i

HEADLINE = (
    "quality_suite",
    "quality_gate",
    "rule_duplicates",
    "rule_referential_integrity",
    "data_drift",
    "profile_report",
    "profile_numeric",
    "profile_numeric_approx",
    "profile_categorical",
    "profile_outliers",
    "customer_features",
    "training_set",
    "feature_lookup",
    "feature_upsert",
    "change_feed",
    "split_counts",
    "classification_metrics",
    "roc_auc_by_model",
    "metrics_table",
    "promotion_recommendation",
    "promotion_metadata_check",
    "manifest_check",
    "alias_state",
    "alias_history",
    "model_versions",
    "monitoring_report",
    "score_batch",
    "stream_quality_hourly",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gaugeworks-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Compute every output column of every row and throw it away."""
    df.write.format("noop").mode("overwrite").save()


def timed(action, runs: int) -> float:
    action()
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def one_action_per_check(df: DataFrame) -> None:
    """The rules of the suite, each asked of Spark on its own."""
    total = df.count()
    df.select("customer_id").distinct().count()
    for c in i.REQUIRED:
        df.where(F.col(c).isNull()).count()
        df.count()
    for c, values in (("contract_type", i.CONTRACTS), ("internet_service", i.SERVICES)):
        df.where(F.col(c).isNotNull() & ~F.col(c).isin(*values)).count()
    for c, high in (("tenure_months", 600), ("monthly_charges", 100_000)):
        df.where((F.col(c) < 0) | (F.col(c) > high)).count()
    df.where("churn = 1").count()
    assert total >= 0


def one_action_per_statistic(df: DataFrame) -> None:
    """The sections of the profile, each asked of Spark on its own."""
    df.count()
    df.agg(*[F.sum(F.col(c).isNull().cast("int")) for c in i.REQUIRED]).collect()
    df.select("customer_id").distinct().count()
    df.agg(*[f(c) for c in i.NUMERIC for f in (F.min, F.max, F.avg, F.stddev)]).collect()
    for c in i.NUMERIC:
        df.approxQuantile(c, [0.25, 0.5, 0.75], 0.01)
        low, high = df.approxQuantile(c, [0.25, 0.75], 0.01)
        reach = 1.5 * (high - low)
        df.where((F.col(c) < low - reach) | (F.col(c) > high + reach)).count()
    for c in i.CATEGORICAL:
        df.select(c).distinct().count()
        df.groupBy(c).count().orderBy(F.desc("count")).limit(50).collect()
    df.groupBy("churn").count().collect()
    for k, a in enumerate(i.NUMERIC):
        for b in i.NUMERIC[k + 1 :]:
            df.stat.corr(a, b)
    df.agg(F.min("signup_date"), F.max("signup_date")).collect()
    df.groupBy(F.date_format("signup_date", "yyyy-MM").alias("m")).count().orderBy("m").collect()


def compare(spark: SparkSession, sf_dir: str, runs: int) -> dict[str, float]:
    from gaugeworks.operators.profile import profile_report
    from gaugeworks.plans.profiles import SPEC
    from gaugeworks.plans.quality import standard_suite
    from gaugeworks.workspace import fresh_path

    path = fresh_path(spark, "bench")
    i.churn_dirty(spark, sf_dir).write.parquet(path)
    df = spark.read.parquet(path)
    return {
        "quality_compiled": timed(lambda: run(standard_suite(df).evaluate(df)), runs),
        "quality_one_action_per_check": timed(lambda: one_action_per_check(df), runs),
        "profile_compiled": timed(lambda: run(profile_report(df, SPEC)), runs),
        "profile_one_action_per_statistic": timed(lambda: one_action_per_statistic(df), runs),
    }


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    keys = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for key in keys:
        seconds[key] = timed(lambda: run(queries[key](spark, sf_dir)), runs)
        print(f"{key}: {seconds[key]}", file=sys.stderr)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_COMPARE"):
        result["compare"] = compare(spark, sf_dir, runs)
    print(json.dumps(result))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
