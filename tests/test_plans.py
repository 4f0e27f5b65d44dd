"""The shape of the physical plans, and rules the sources must keep."""

from __future__ import annotations

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from gaugeworks.operators import evaluation as e
from gaugeworks.operators import features as f
from gaugeworks.operators import profile as p
from gaugeworks.operators import registry as g
from gaugeworks.operators.drift import mean_shift
from gaugeworks.plans import inputs as i

QUERIES = entry_module.queries()
PACKAGE = pathlib.Path(entry_module.__file__).parent / "gaugeworks"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limits_reach_the_map_tasks(spark, sf_dir):
    events = i.alias_events(spark, sf_dir)
    assert "WindowGroupLimit" in physical(g.alias_state(events))
    assert "WindowGroupLimit" in physical(p.profile_categorical(events, ["action"], 50))


def test_drift_is_one_aggregation(spark, sf_dir):
    lines = i.table(spark, sf_dir, "lineitem")
    plan = physical(mean_shift(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), ["l_tax"]))
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,A)]" in plan


def test_a_report_plans_two_readings_of_its_table(spark, sf_dir):
    one = physical(i.churn_dirty(spark, sf_dir)).count("FileScan")
    assert physical(QUERIES["profile_report"](spark, sf_dir)).count("FileScan") == 2 * one <= 6


def test_narrow_operators_do_not_shuffle(spark, sf_dir):
    orders = i.table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "customer_id", "o_orderdate": "ts"})
    for df in (
        f.impute(orders, ["o_totalprice"], ["o_orderstatus"]),
        orders.select(f.split_column(F.col("customer_id"), 0.7, 0.15, 0.15, 42)),
        f.split_rows(orders, "customer_id")[0],
    ):
        assert "Exchange" not in physical(df)


def test_only_used_columns_are_read(spark, sf_dir):
    lines = i.table(spark, sf_dir, "lineitem")
    plan = physical(p.profile_numeric(lines, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in plan


def test_one_scan_for_many_curves(spark, sf_dir):
    assert physical(QUERIES["roc_auc_by_model"](spark, sf_dir)).count("FileScan") == 1
    assert physical(QUERIES["promotion_recommendation"](spark, sf_dir)).count("FileScan") == 1


@pytest.mark.parametrize("key", ["quality_suite", "profile_report", "metrics_table", "alias_history", "training_set", "monitoring_report"])
def test_no_python_and_no_cross_product_in_the_plan(spark, sf_dir, key):
    plan = physical(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", plan)


def test_metrics_of_one_model_need_no_join(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5)], "label int, prediction double, score double")
    assert "Join" not in physical(e.metrics_table(df))


def test_sources_avoid_what_does_not_scale():
    text = "\n".join(path.read_text() for path in PACKAGE.rglob("*.py"))
    for word in ("localCheckpoint", "crossJoin", "toPandas", ".rdd", "randomSplit", "pandas_udf", "F.udf"):
        hits = [line for line in text.splitlines() if word in line and "``" not in line]
        assert hits == [], word
