from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.errors import FeatureError
from gaugeworks.functions.joins import lookup_join
from gaugeworks.operators import features as f



def test_customer_features_without_tenure(spark):
    df = spark.createDataFrame(
        [("new", 0, 50.0, 0.0, 2), ("bad", -1, 7.0, 1.0, 3), ("null", None, 9.0, 1.0, 1), ("open", 10, 5.0, None, None)],
        "customer_id string, tenure_months int, monthly_charges double, total_charges double, support_calls int",
    )
    rows = {r["customer_id"]: r for r in f.customer_features(df, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert (rows["new"]["avg_monthly_charge_ratio"], rows["new"]["support_calls_per_tenure_month"]) == (50.0, 2.0)
    assert (rows["bad"]["avg_monthly_charge_ratio"], rows["bad"]["support_calls_per_tenure_month"]) == (7.0, None)
    assert rows["null"]["avg_monthly_charge_ratio"] == 9.0
    assert rows["open"]["avg_monthly_charge_ratio"] is None


def test_impute_keeps_types(spark):
    df = spark.createDataFrame([(None, None, None), (1, math.nan, "x")], "n int, d double, c string")
    filled = f.impute(df, ["n", "d", "gone"], ["c"])
    assert filled.dtypes == df.dtypes
    assert [tuple(r) for r in filled.collect()] == [(0, 0.0, "unknown"), (1, 0.0, "x")]
    assert f.impute(df, [], []) is df


def test_split_depends_on_the_key_only(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    first = [{r["k"] for r in part.collect()} for part in f.split_rows(df.coalesce(1), "k")]
    second = [{r["k"] for r in part.collect()} for part in f.split_rows(df.repartition(7), "k")]
    assert first == second
    assert sum(map(len, first)) == 2000
    assert 0.65 < len(first[0]) / 2000 < 0.75
    with pytest.raises(FeatureError):
        f.split_rows(df, "k", 0.7, 0.2, 0.2)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, a tenth have none."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 500)
    return spark.range(6000).select(key.alias("k"), F.col("id").alias("row"))


@pytest.fixture(scope="module")
def lookup(spark):
    # NULL keys on this side must match nothing either.
    return spark.range(400).select("id", (F.col("id") * 2).alias("v")).withColumnRenamed("id", "k").unionByName(
        spark.createDataFrame([(None, 1), (None, 2)], "k bigint, v bigint")
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spreading_hot_keys_changes_nothing(skewed, lookup, how):
    spread = lookup_join(skewed, lookup, ["k"], how, hot_share=0.05)
    assert "__number" in spread._jdf.queryExecution().optimizedPlan().toString()
    assert spread.columns == ["k", "row", "v"]
    rows = sorted(spread.collect(), key=repr)
    assert rows == sorted(lookup_join(skewed, lookup, ["k"], how).collect(), key=repr)
    if how == "left":
        assert len(rows) == 6000


def test_a_right_side_of_many_rows_per_key(skewed, lookup):
    many = lookup.unionByName(lookup)
    assert sorted(lookup_join(skewed, many, ["k"], hot_share=0.05).collect()) == sorted(lookup_join(skewed, many, ["k"]).collect())


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(
    "left, right",
    [("int", "bigint"), ("bigint", "int"), ("decimal(10,2)", "decimal(20,4)"), ("decimal(12,0)", "bigint"), ("date", "timestamp"), ("string", "int"), ("float", "double")],
)
def test_hot_keys_of_other_types(spark, how, left, right):
    def keys(kind, n):
        number = F.pmod(n, F.lit(40)).cast("int")
        return F.date_add(F.lit("2024-01-01"), number).cast(kind) if kind in ("date", "timestamp") else number.cast(kind)

    hot = F.when(F.col("id") < 600, F.lit(3)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id"))
    labels = spark.range(1000).select(keys(left, hot).alias("k"), F.lit(1).alias("j"), F.col("id").alias("row"))
    features = spark.range(30).select(keys(right, F.col("id")).alias("k"), F.lit(1).cast("bigint").alias("j"), F.col("id").alias("v"))
    plain = lookup_join(labels, features, ["k", "j"], how)
    spread = lookup_join(labels, features, ["k", "j"], how, hot_share=0.3)
    assert spread.dtypes == plain.dtypes
    assert "__number" in spread._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(spread.collect(), key=repr)
    assert rows == sorted(plain.collect(), key=repr) and sum(r["v"] == 3 for r in rows) >= 600


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("collation", ["UTF8_LCASE", "UNICODE_CI", "UTF8_BINARY_RTRIM"])
def test_hot_keys_that_a_collation_holds_for_equal(spark, how, collation):
    spelled = "CASE WHEN id % 100 = 99 THEN NULL WHEN id < 700 THEN 'AB' WHEN id < 800 THEN 'ab ' WHEN id < 900 THEN 'Ab' ELSE string(id % 7) END"
    labels = spark.range(1000).selectExpr(f"{spelled} COLLATE {collation} AS k", "1 AS j", "id AS row")
    features = spark.createDataFrame([("ab", 1, 7), ("3", 1, 8), ("x", 1, 9), (None, 1, 0)], "k string, j bigint, v int")
    features = features.selectExpr(f"k COLLATE {collation} AS k", "j", "v")
    plain = lookup_join(labels, features, ["k", "j"], how)
    spread = lookup_join(labels, features, ["k", "j"], how, hot_share=0.05)
    assert spread.columns == plain.columns
    assert "__number" in spread._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))
    assert plain.where("v = 7").count() >= (99 if collation == "UTF8_BINARY_RTRIM" else 700)


def test_training_set_keeps_repeated_labels_and_drops_unknown_ones(spark):
    spec = f.FeatureSpec("t", ("a", "b"), ("x",))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0), (None, 1, 1)], "a int, b int, y int")
    features = spark.createDataFrame([(1, 1, "p", 0), (3, 1, "q", 0), (None, 1, "r", 0)], "a int, b int, x string, other int")
    joined = f.training_set(labels, features, spec, "y")
    assert joined.columns == ["a", "b", "y", "x"]
    assert sorted(tuple(r) for r in joined.collect()) == [(1, 1, 0, "p"), (1, 1, 1, "p")]
    assert tuple(f.unmatched_labels(labels, features, spec).first()) == (2, 2)
    looked_up = f.feature_lookup(labels.drop("y"), features, spec)
    assert sorted((r["x"] or "-") for r in looked_up.collect()) == ["-", "-", "p", "p"]
