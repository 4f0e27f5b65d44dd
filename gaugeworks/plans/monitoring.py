"""Monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import monitoring as m
from gaugeworks.operators.drift import mean_shift
from gaugeworks.operators.evaluation import metrics_table
from gaugeworks.operators.promotion import MINIMA
from gaugeworks.plans import inputs as i
from gaugeworks.plans.quality import NO_BASELINE, suite_sql, standard_suite
from gaugeworks.plans.sql import over

# Stricter than the usual minima, so that some metrics fall short on the given data.
STRICT = {name: 0.75 for name in MINIMA}


def _model() -> m.MonitoredModel:
    return m.MonitoredModel("customer-model", "R", "prd", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def _alerts(rows: DataFrame) -> DataFrame:
    return rows.select("rule", "severity", "observed_num", "model_name", "model_version", "environment")


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers gone against customers still active."""
    churn = i.churn(spark, sf_dir)
    return mean_shift(churn.where("churn = 1"), churn.where("churn = 0"), i.NUMERIC)


def data_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = i.churn_dirty(spark, sf_dir)
    return _alerts(m.data_alerts(standard_suite(df).evaluate(df), _model(), _drift(spark, sf_dir)))


def prediction_monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.prediction_summary(i.scored(spark, sf_dir), score="score").drop("inference_latency_ms")


def prediction_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that are positive too often, and some that are missing."""
    scored = i.scored(spark, sf_dir).where("prediction IS NULL OR prediction = 1 OR score < 0.1")
    return _alerts(m.prediction_alerts(m.prediction_summary(scored, score="score"), _model()))


def performance_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(m.performance_alerts(metrics_table(i.scored(spark, sf_dir)), STRICT, _model()))


def monitoring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = i.churn_dirty(spark, sf_dir)
    report = m.monitoring_report(
        standard_suite(df).evaluate(df), _drift(spark, sf_dir), i.scored(spark, sf_dir), STRICT, _model()
    )
    return report.select("source", "rule", "severity", "observed_num")


QUERIES = {
    fn.__name__: fn
    for fn in (data_alerts, prediction_monitoring, prediction_alerts, performance_alerts, monitoring_report)
}

_WHO = "'customer-model' AS model_name, 'R' AS model_version, 'prd' AS environment"


def _drift_sql() -> str:
    rows = [
        f"SELECT 'data_drift[{c}]' AS rule, 'warning' AS severity, ROUND(ABS(a.x - b.x) / ABS(b.x), 4) AS observed "
        f"FROM (SELECT AVG({c}) AS x FROM churn WHERE churn = 1) a, (SELECT AVG({c}) AS x FROM churn WHERE churn = 0) b"
        for c in i.NUMERIC
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) d WHERE observed > 0.2"


_DATA = (
    f"SELECT rule, severity, observed FROM ({suite_sql(NO_BASELINE)}) v WHERE status = 'fail' UNION ALL {_drift_sql()}"
)

_SUMMARY = """
SELECT COUNT(*) AS row_count, COUNT(*) FILTER (WHERE prediction = 1) AS positive_count,
  ROUND(CAST(COUNT(*) FILTER (WHERE prediction = 1) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) AS positive_rate,
  ROUND(CAST(COUNT(*) - COUNT(prediction) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) AS error_rate,
  CAST(0 AS DOUBLE) AS nan_score_rate
FROM scored
"""

_PREDICTIONS = """
SELECT 'prediction_distribution' AS rule, 'warning' AS severity, positive_rate AS observed FROM summary
WHERE positive_rate > 0.6 OR positive_rate < 0.01
UNION ALL SELECT 'prediction_error_rate', 'error', error_rate FROM summary WHERE error_rate > 0.01
"""

_PERFORMANCE = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'model_performance_degradation[{n}]' AS rule, 'critical' AS severity, \"{n}\" AS observed FROM classification, auc"
    for n in ("accuracy", "precision", "recall", "f1_score", "roc_auc")
) + ") p WHERE observed < 0.75"


def _alert_sql(body: str) -> str:
    return f"SELECT rule, severity, observed AS observed_num, {_WHO} FROM ({body}) a"


ORACLES = {
    "data_alerts": over("churn_dirty", _alert_sql(_DATA)),
    "prediction_monitoring": over("scored", _SUMMARY),
    "prediction_alerts": over(
        "scored",
        _alert_sql(_PREDICTIONS),
        summary=_SUMMARY.replace("FROM scored", "FROM scored WHERE prediction IS NULL OR prediction = 1 OR score < 0.1"),
    ),
    "performance_alerts": over("classification auc", _alert_sql(_PERFORMANCE)),
    "monitoring_report": over(
        "churn_dirty classification auc",
        f"SELECT 'data' AS source, rule, severity, observed AS observed_num FROM ({_DATA}) a "
        f"UNION ALL SELECT 'predictions', rule, severity, observed FROM ({_PREDICTIONS}) b "
        f"UNION ALL SELECT 'performance', rule, severity, observed FROM ({_PERFORMANCE}) c",
        summary=_SUMMARY,
    ),
}
