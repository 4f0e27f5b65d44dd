from __future__ import annotations

import random

from pyspark.sql import functions as F

from gaugeworks.operators import rules as r
from gaugeworks.operators.sketches import distinct_sketches, from_sketches, merged_sketches
from gaugeworks.operators.suite import QualitySuite


def days(spark, count, rows=4000):
    rng = random.Random(5)
    data = [(d, rng.randrange(20_000) if rng.random() < 0.9 else None, rng.choice("ab")) for d in range(count) for _ in range(rows)]
    return spark.createDataFrame(data, "day int, k int, v string").repartition(4)


def test_merged_sketches_are_close_and_null_is_a_key(spark):
    df = days(spark, 6)
    sets = (("k",), ("k", "v"), ("v",))
    parts = distinct_sketches(df, sets, F.col("day"))
    assert parts.count() == 18
    found = {row["keys"]: row for row in merged_sketches(parts).collect()}
    for keys in sets:
        exact = r.distinct_keys(df, keys).first()
        row = found[",".join(keys)]
        assert row[r.ROWS] == exact[r.ROWS] == 24_000
        assert abs(row["n_keys"] - exact["n_keys"]) <= max(0.03 * exact["n_keys"], 0)
    assert found["v"]["n_keys"] == 2
    assert merged_sketches(parts.limit(0)).collect() == []


def test_a_new_day_reads_only_its_rows(spark, tmp_path):
    df = days(spark, 5)
    path = str(tmp_path / "sketches")

    def store(rows):
        distinct_sketches(rows, [("k",)], F.col("day")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("part").parquet(path)

    store(df.where("day < 4"))
    store(df.where("day = 4"))
    store(df.where("day = 4"))  # a retried run replaces its day
    stored = spark.read.parquet(path)
    whole = merged_sketches(distinct_sketches(df, [("k",)], F.col("day"))).first()
    assert tuple(merged_sketches(stored).first()) == tuple(whole)


def test_rules_from_sketches(spark):
    df = days(spark, 3)
    parts = distinct_sketches(df, [("k",), ("v",)], F.col("day"))
    rules = [r.duplicates(["k"], 0.2), r.cardinality("v", 2), r.cardinality("k", 100)]
    exact = {row["rule"]: row for row in QualitySuite(rules).evaluate(df).collect()}
    # The table itself is not read: an empty one gives the verdict over what is stored.
    sketched = {row["rule"]: row for row in QualitySuite([from_sketches(rule, parts) for rule in rules]).evaluate(df.limit(0)).collect()}
    for rule in rules:
        a, b = exact[rule.name], sketched[f"{rule.name}~"]
        assert (a["status"], a["row_count"]) == (b["status"], b["row_count"])
        assert abs(a["observed_num"] - b["observed_num"]) <= max(0.03 * a["observed_num"], 0.02)
