from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import monitoring as m
from gaugeworks.operators import rules as r
from gaugeworks.operators.suite import QualitySuite


@pytest.fixture
def model(spark):
    return m.MonitoredModel("churn", "3", "prd", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def predictions(spark, *values):
    return spark.createDataFrame([(v, 0.5) for v in values], "prediction double, score double")


def rules_of(alerts):
    return sorted((row["rule"], row["severity"]) for row in alerts.collect())


def test_missing_predictions(spark, model):
    summary = m.prediction_summary(predictions(spark, 1.0, None, None))
    row = summary.first()
    assert (row["row_count"], row["positive_rate"], row["error_rate"]) == (3, 0.3333, 0.6667)
    assert rules_of(m.prediction_alerts(summary, model)) == [("prediction_error_rate", "error")]


def test_implausible_rates(spark, model):
    high = m.prediction_alerts(m.prediction_summary(predictions(spark, 1.0, 1.0)), model)
    assert rules_of(high) == [("prediction_distribution", "warning")]
    assert high.first()["threshold"] == "[0.01, 0.6]"
    none = m.prediction_alerts(m.prediction_summary(predictions(spark, 0.0, 0.0)), model)
    assert rules_of(none) == [("prediction_distribution", "warning")]
    assert rules_of(m.prediction_alerts(m.prediction_summary(predictions(spark, 1.0, 0.0)), model)) == []


def test_no_rows_no_alert(spark, model):
    summary = m.prediction_summary(predictions(spark).limit(0))
    assert summary.first()["row_count"] == 0
    assert rules_of(m.prediction_alerts(summary, model)) == []


def test_nan_scores_are_errors(spark, model):
    df = spark.createDataFrame([(0.0, math.nan), (1.0, 0.9)], "prediction double, score double")
    assert rules_of(m.prediction_alerts(m.prediction_summary(df, score="score"), model)) == [("prediction_nan_score_rate", "error")]


def test_data_alerts_cover_every_severity(spark, model):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "id int, extra string")
    suite = QualitySuite([r.extra_columns(df.schema, ["id"]), r.duplicates(["id"], 0.0), r.row_count(1, 5)])
    drift = spark.createDataFrame([("a", 0.2), ("b", 0.21), ("c", None)], "column string, relative_mean_shift double")
    alerts = m.data_alerts(suite.evaluate(df), model, drift)
    assert rules_of(alerts) == [("data_drift[b]", "warning"), ("duplicates[id]", "error"), ("extra_columns", "warning")]
    assert {(row["model_name"], row["model_version"], row["environment"]) for row in alerts.collect()} == {("churn", "3", "prd")}


def test_performance_alerts(spark, model):
    scored = spark.createDataFrame([(1, 1.0, 0.9), (0, 1.0, 0.8), (0, 0.0, 0.1)], "label int, prediction double, score double")
    metrics, alerts = m.monitor_performance(scored, {"accuracy": 0.7, "roc_auc": 0.7}, model)
    assert metrics.first()["accuracy"] == 0.666667
    assert rules_of(alerts) == [("model_performance_degradation[accuracy]", "critical")]
    assert m.has_critical(alerts)
    assert not m.has_critical(m.monitor_performance(scored.limit(0), {"accuracy": 0.7}, model)[1])


def test_monitoring_run_writes_its_reports(spark, model, tmp_path):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    results = QualitySuite([r.duplicates(["id"], 0.0), r.row_count(1, 5)]).evaluate(df)
    scored = spark.createDataFrame([(1, 1.0, 0.9), (0, 1.0, 0.8), (0, 0.0, 0.1)], "label int, prediction double, score double")
    for _ in range(2):  # a retried run leaves one copy
        assert m.run_monitoring(results, None, scored, {"accuracy": 0.7}, model, str(tmp_path), "run-1")
    assert not m.run_monitoring(results, None, scored, {"accuracy": 0.1}, model, str(tmp_path), "run-2")
    counts = {n: spark.read.parquet(str(tmp_path / n)).count() for n in ("rules", "predictions", "performance", "alerts")}
    assert counts == {"rules": 4, "predictions": 2, "performance": 2, "alerts": 5}
