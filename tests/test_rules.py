"""NULL, NaN and empty-table behaviour of the rules, and the suite as a whole."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gaugeworks.errors import QualityGateError
from gaugeworks.operators import rules as r
from gaugeworks.operators import suite as s
from gaugeworks.operators.drift import mean_shift

SCHEMA = "id string, amount double, kind string, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def verdict(df, rule):
    (row,) = s.QualitySuite([rule]).evaluate(df).collect()
    return row


@pytest.fixture(scope="module")
def rows(spark):
    return frame(
        spark,
        [
            ("a", 1.0, "x", 1),
            ("a", math.nan, "y", 0),
            (None, None, None, None),
            (None, -5.0, "z", 0),
        ],
    ).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_nan_is_not_null(rows):
    row = verdict(rows, r.null_percentage("amount", 0.25))
    assert (row["status"], row["observed_num"], row["observed"]) == ("pass", 0.25, "0.25")


def test_null_passes_a_range_and_nan_fails_it(rows):
    assert verdict(rows, r.value_range("amount", 0, 10))["observed"] == "2"
    assert verdict(rows.where("amount IS NULL"), r.value_range("amount", 0, 10))["status"] == "pass"


def test_null_is_one_key_and_one_category(rows):
    duplicates = verdict(rows, r.duplicates(["id"], 0.4))
    assert (duplicates["observed_num"], duplicates["status"]) == (0.5, "fail")
    assert verdict(rows, r.cardinality("id", 2))["observed"] == "2"
    assert verdict(rows, r.cardinality("kind", 3))["status"] == "fail"
    assert verdict(rows, r.cardinality("kind", 4, approximate=True))["observed"] == "4"


def test_null_is_inside_every_domain(rows):
    assert verdict(rows, r.allowed_domain("kind", ["x", "y"]))["observed"] == "1"
    assert verdict(rows, r.allowed_domain("label", [0, 1]))["status"] == "pass"


def test_quotes_in_a_domain(spark):
    df = frame(spark, [("a", 1.0, "it's", 1), ("b", 1.0, "back\\slash", 1)])
    assert verdict(df, r.allowed_domain("kind", ["it's", "back\\slash"]))["status"] == "pass"


def test_domain_table_counts_rows_and_reference_counts_values(spark, rows):
    known = spark.createDataFrame([("x",), ("x",), (None,)], "value string")
    more = rows.unionByName(frame(spark, [("b", 1.0, "z", 1)]))
    assert verdict(more, r.allowed_domain_table("kind", known, "value"))["observed"] == "3"
    # y, z and NULL have no match; z counts once.
    orphans = verdict(more, r.referential_integrity("kind", known, "value"))
    assert (orphans["observed"], orphans["row_count"]) == ("3", 5)


def test_target_distribution(rows, empty):
    assert verdict(rows, r.target_distribution("label"))["observed_num"] == 0.25
    assert verdict(rows, r.target_distribution("label", 0.3, 0.9))["status"] == "fail"
    assert verdict(empty, r.target_distribution("label"))["status"] == "fail"


def test_shares_of_an_empty_table_are_zero(empty):
    for rule in (r.null_percentage("id", 0.0), r.duplicates(["id"], 0.0), r.value_range("amount", 0, 1)):
        row = verdict(empty, rule)
        assert (row["status"], row["observed_num"], row["row_count"]) == ("pass", 0.0, 0)


def test_row_count_bounds_are_inclusive(rows):
    assert verdict(rows, r.row_count(4, 4))["status"] == "pass"
    assert verdict(rows, r.row_count(5, 9))["blocking"]


@pytest.mark.parametrize(
    ("previous", "severity", "status", "observed"),
    [(None, "info", "pass", 4.0), (0, "info", "pass", 4.0), (8, "warning", "pass", 0.5), (2, "warning", "fail", 1.0)],
)
def test_volume_change(rows, previous, severity, status, observed):
    row = verdict(rows, r.volume_change(previous, 0.5))
    assert (row["severity"], row["status"], row["observed_num"]) == (severity, status, observed)


def test_volume_change_against_the_last_report(spark, rows):
    reports = spark.createDataFrame([(1, 100), (2, 5)], "run int, row_count bigint")
    row = verdict(rows, r.volume_change(s.previous_row_count(reports, "run"), 0.5))
    assert row["observed_num"] == 0.2


def test_missing_required_column_stops_the_suite(rows):
    suite = s.QualitySuite([r.row_count(1, 9), r.required_columns(rows.schema, ["id", "gone"]), r.row_count(1, 9)])
    (row,) = suite.evaluate(rows).collect()
    assert (row["rule"], row["status"], row["observed"], row["blocking"]) == ("required_columns", "fail", "[gone]", True)


def test_rules_of_absent_columns_are_skipped(rows):
    suite = s.QualitySuite([r.row_count(1, 9), r.null_percentage("gone", 0.1), r.extra_columns(rows.schema, ["id"])])
    found = {row["rule"]: row for row in suite.evaluate(rows).collect()}
    assert set(found) == {"row_count", "extra_columns"}
    assert found["extra_columns"]["observed"] == "[amount, kind, label]"
    assert not found["extra_columns"]["blocking"]


def test_schema_drift_names_the_fields(rows):
    same = verdict(rows, r.schema_drift(rows.schema, rows.schema))
    assert (same["status"], same["observed"]) == ("pass", "unchanged")
    changed = StructType([StructField("id", LongType()), *rows.schema.fields[2:]])
    row = verdict(rows, r.schema_drift(rows.schema, changed))
    assert row["observed"] == "id: type; amount: added"
    moved = StructType(list(reversed(rows.schema.fields)))
    assert verdict(rows, r.schema_drift(rows.schema, moved))["status"] == "fail"
    strict = StructType([StructField(f.name, f.dataType, False) for f in rows.schema.fields])
    assert "nullable" in verdict(rows, r.schema_drift(rows.schema, strict))["observed"]


def test_own_rule(rows):
    rule = r.Rule(
        name="mean_amount",
        description="mean below a limit",
        severity=r.WARNING,
        expected="< 0",
        observed="m",
        passed="m < 0",
        aggregates={"m": "avg(if(isnan(amount), NULL, amount))"},
    )
    row = verdict(rows, rule)
    assert (row["status"], row["observed_num"]) == ("pass", -2.0)


def suite_of(df):
    return s.table_suite(
        df.schema, required=["id", "amount", "kind", "label"], key="id", domains={"kind": ["x"]}, target="label"
    )


def test_gate_and_summary(rows):
    results = suite_of(rows).evaluate(rows)
    (summary,) = s.summarize(results).collect()
    assert not summary["passed"] and summary["row_count"] == 4
    with pytest.raises(QualityGateError) as error:
        s.enforce_gate(results)
    assert "duplicates[id]" in error.value.failed_rules
    assert len(error.value.failed_rules) == summary["n_blocking"]
    s.enforce_gate(s.QualitySuite([r.row_count(1, 9)]).evaluate(rows))


def test_report_gate_needs_an_explicit_pass(spark, rows):
    reports = spark.createDataFrame([("a", True, 4), ("b", False, 4), ("c", None, 4)], "run_id string, passed boolean, row_count bigint")
    results = s.QualitySuite([r.row_count(1, 9)]).evaluate(rows)
    tagged = results.withColumn("run_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    gates = {row["run_id"]: row["gate_passed"] for row in s.gate_reports(tagged, reports).collect()}
    assert gates == {"a": True, "b": False, "c": False}


def test_suite_reads_a_table_twice_at_most(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = suite_of(df).evaluate(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    assert "Python" not in plan


def test_drift(spark):
    current = frame(spark, [("a", 3.0, "x", 0), ("b", 5.0, "x", None)])
    reference = frame(spark, [("a", 2.0, "x", 0), ("b", 2.0, "x", 0)])
    found = {row["column"]: row for row in mean_shift(current, reference, ["amount", "label"]).collect()}
    assert found["amount"]["relative_mean_shift"] == 1.0
    assert found["label"]["relative_mean_shift"] is None  # reference mean is zero
    none = {row["column"]: row for row in mean_shift(current.limit(0), reference, ["amount"]).collect()}
    assert (none["amount"]["current_mean"], none["amount"]["relative_mean_shift"]) == (None, 1.0)
