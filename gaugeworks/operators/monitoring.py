"""Alerts from data quality, predictions and model performance."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gaugeworks.functions.columns import rows_from_sql, share, struct_sql, text_literal
from gaugeworks.operators.evaluation import metrics_of, metrics_table, tally
from gaugeworks.operators.promotion import METRICS
from gaugeworks.operators.suite import failed_rules
from gaugeworks.sources.writers import write_report

# The alert limits.
MAX_MEAN_SHIFT = 0.2
MIN_POSITIVE_RATE, MAX_POSITIVE_RATE = 0.01, 0.6
MAX_ERROR_RATE = 0.01
_DIGITS = 4


@dataclass(frozen=True)
class MonitoredModel:
    """Which model and run an alert is about."""

    name: str
    version: str
    environment: str
    timestamp: Column


def _alerts(rows: DataFrame, model: MonitoredModel) -> DataFrame:
    """Rows of (rule, severity, observed_value, threshold, observed_num) become alerts."""
    return rows.select(
        "rule",
        "severity",
        "observed_value",
        "threshold",
        "observed_num",
        F.lit(model.name).alias("model_name"),
        F.lit(model.version).alias("model_version"),
        F.lit(model.environment).alias("environment"),
        model.timestamp.alias("timestamp"),
    )


def _candidate(rule: str, severity: str, observed: str, threshold: str, raised: str) -> str:
    """A possible alert as SQL text: ``observed`` names a column, ``raised`` is a condition."""
    return struct_sql(
        rule=text_literal(rule),
        severity=text_literal(severity),
        observed_value=f"string({observed})",
        threshold=text_literal(threshold),
        observed_num=observed,
        raised=raised,
    )


def data_alerts(
    results: DataFrame, model: MonitoredModel, drift: DataFrame | None = None, max_shift: float = MAX_MEAN_SHIFT
) -> DataFrame:
    """One alert per failed rule of any severity, and one per column whose mean moved too far."""
    rows = failed_rules(results).select(
        "rule", "severity", F.col("observed").alias("observed_value"), F.col("expected").alias("threshold"), "observed_num"
    )
    if drift is not None:
        shift = F.col("relative_mean_shift")
        moved = drift.where(shift > max_shift).select(
            F.concat(F.lit("data_drift["), F.col("column"), F.lit("]")).alias("rule"),
            F.lit("warning").alias("severity"),
            shift.cast("string").alias("observed_value"),
            F.lit(str(max_shift)).alias("threshold"),
            shift.alias("observed_num"),
        )
        rows = rows.unionByName(moved)
    return _alerts(rows, model)


def prediction_summary(
    scored: DataFrame, prediction: str = "prediction", score: str | None = None, latency_ms: float | None = None
) -> DataFrame:
    """One row: rows, positives, their rate, the rate of NULL predictions and of NaN scores."""
    columns = [F.col(prediction).alias("prediction"), (F.col(score) if score is not None else F.lit(None).cast("double")).alias("score")]
    return summary_of(scored.select(*columns, F.lit(1).cast("bigint").alias("n")), latency_ms)


def summary_of(tallied: DataFrame, latency_ms: float | None = None) -> DataFrame:
    """:func:`prediction_summary` of rows that stand for ``n`` rows each, such as a tally."""
    sums = {
        "row_count": "true",
        "positive_count": "prediction = 1.0D",
        "__nulls": "prediction IS NULL",
        "__nans": "isnan(score)",
    }
    row = tallied.agg(*[F.expr(f"coalesce(sum(n) FILTER (WHERE {held}), 0L) AS {name}") for name, held in sums.items()])
    n = F.col("row_count")
    return row.select(
        "row_count",
        "positive_count",
        F.round(share(F.col("positive_count"), n), _DIGITS).alias("positive_rate"),
        F.round(share(F.col("__nulls"), n), _DIGITS).alias("error_rate"),
        F.round(share(F.col("__nans"), n), _DIGITS).alias("nan_score_rate"),
        F.lit(latency_ms).cast("double").alias("inference_latency_ms"),
    )


def prediction_alerts(summary: DataFrame, model: MonitoredModel) -> DataFrame:
    """Warn on an implausible positive rate; error on missing predictions or NaN scores. No rows, no alert."""
    limits = f"[{MIN_POSITIVE_RATE}, {MAX_POSITIVE_RATE}]"
    structs = [
        _candidate(
            "prediction_distribution",
            "warning",
            "positive_rate",
            limits,
            f"positive_rate > {MAX_POSITIVE_RATE}D OR positive_rate < {MIN_POSITIVE_RATE}D",
        ),
        *[
            _candidate(rule, "error", rate, str(MAX_ERROR_RATE), f"{rate} > {MAX_ERROR_RATE}D")
            for rule, rate in (
                ("prediction_error_rate", "error_rate"),
                ("prediction_nan_score_rate", "nan_score_rate"),
            )
        ],
    ]
    rows = summary.where(F.col("row_count") > 0).select(rows_from_sql(structs)).where("raised")
    return _alerts(rows, model)


def performance_alerts(metrics: DataFrame, minima: Mapping[str, float], model: MonitoredModel) -> DataFrame:
    """A critical alert per metric below its minimum. A metrics frame without rows gives none."""
    structs = [
        _candidate(f"model_performance_degradation[{m}]", "critical", m, str(minima[m]), f"{m} < {minima[m]}D")
        for m in METRICS
        if m in minima
    ]
    return _alerts(metrics.select(rows_from_sql(structs)).where("raised"), model)


def monitor_performance(
    scored: DataFrame, minima: Mapping[str, float], model: MonitoredModel
) -> tuple[DataFrame, DataFrame]:
    """Metrics and alerts of labelled, scored rows."""
    metrics = metrics_table(scored)
    return metrics, performance_alerts(metrics, minima, model)


def monitoring_report(
    results: DataFrame,
    drift: DataFrame | None,
    scored: DataFrame,
    minima: Mapping[str, float],
    model: MonitoredModel,
) -> DataFrame:
    """All alerts of one run: data, then predictions, then performance, the last two from one tally of the scored rows."""
    tallied = tally(scored)
    parts = {
        "data": data_alerts(results, model, drift),
        "predictions": prediction_alerts(summary_of(tallied), model),
        "performance": performance_alerts(metrics_of(tallied), minima, model),
    }
    report = None
    for source, rows in parts.items():
        rows = rows.withColumn("source", F.lit(source))
        report = rows if report is None else report.unionByName(rows)
    return report


def run_monitoring(
    results: DataFrame,
    drift: DataFrame | None,
    scored: DataFrame,
    minima: Mapping[str, float],
    model: MonitoredModel,
    path: str,
    run_id: str,
) -> bool:
    """Write rule results, prediction summary, metrics and alerts of a run; True when an alert is critical.

    The scored rows are needed three times, so their three columns are kept while
    the reports are written.
    """
    narrow = scored.select("label", "prediction", "score").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        reports = {
            "rules": results,
            "predictions": prediction_summary(narrow, score="score"),
            "performance": metrics_table(narrow),
            "alerts": monitoring_report(results, drift, narrow, minima, model),
        }
        for name, rows in reports.items():
            write_report(rows, f"{path}/{name}", run_id)
    finally:
        narrow.unpersist()
    alerts = scored.sparkSession.read.parquet(f"{path}/alerts")
    return has_critical(alerts.where(F.col("run_id") == run_id))


def has_critical(alerts: DataFrame) -> bool:
    return not alerts.where(F.col("severity") == "critical").isEmpty()
