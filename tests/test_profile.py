from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pandas
import pytest
from pyspark.sql import functions as F

from gaugeworks.errors import SchemaError
from gaugeworks.functions.ordered import previous_value, running_number, top_per_group
from gaugeworks.functions.ranks import exact_quantiles
from gaugeworks.operators import profile as p

SCHEMA = "id int, a double, b double, kind string, label int, day date"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(k, float(k), None if k % 3 == 0 else 2.0 * k, "even" if k % 2 == 0 else None, k % 2, None) for k in range(1, 21)],
        SCHEMA,
    ).cache()


def test_nulls_of_an_empty_table_have_no_entries(rows):
    assert p.profile_nulls(rows.limit(0)).count() == 0
    found = {r["column"]: r["null_count"] for r in p.profile_nulls(rows).collect()}
    assert (found["b"], found["kind"], found["day"], found["id"]) == (6, 10, 20, 0)


def test_duplicates_count_null_once(rows):
    (row,) = p.profile_duplicates(rows, ["kind"]).collect()
    assert (row["distinct_count"], row["duplicate_count"]) == (2, 18)
    (empty,) = p.profile_duplicates(rows.limit(0), ["kind"]).collect()
    assert (empty["row_count"], empty["duplicate_percentage"]) == (0, 0.0)


def test_categories_are_limited_and_ordered(rows):
    found = p.profile_categorical(rows, ["kind", "label"], 1).collect()
    assert len(found) == 2
    kind = next(r for r in found if r["column"] == "kind")
    assert (kind["value"], kind["count"], kind["distinct_count"], kind["high_cardinality"]) == ("even", 10, 2, True)


def test_many_categories_take_the_sliced_path(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("v"), F.lit("g").alias("g"), (F.col("id") % 7).alias("n"))
    order = [F.desc("n"), F.asc("v")]
    top = [(r["v"], r["rank"]) for r in top_per_group(df, ["g"], order, 1500).collect()]
    expected = sorted(((str(k), k % 7) for k in range(3000)), key=lambda x: (-x[1], x[0]))[:1500]
    assert sorted(top) == sorted((v, k + 1) for k, (v, _) in enumerate(expected))


def test_target(rows):
    (row,) = p.profile_target(rows, "label").collect()
    assert (row["total"], row["positives"], row["imbalance_ratio"]) == (20, 10, 1.0)
    (none,) = p.profile_target(rows.where("label = 0"), "label").collect()
    assert none["imbalance_ratio"] is None
    assert p.profile_target(rows, "gone").count() == 0


def test_correlation_of_complete_pairs_and_with_zeros(rows):
    (row,) = p.profile_correlations(rows, ["a", "b"]).collect()
    assert row["correlation"] == 1.0
    (zero,) = p.profile_correlations(rows, ["a", "b"], nulls_as_zero=True).collect()
    assert zero["correlation"] < 1.0
    assert p.profile_correlations(rows, ["a"]).count() == 0


def test_correlations_as_one_product_of_vectors(spark, monkeypatch):
    rng = random.Random(6)
    cell = lambda k: rng.choice([None, None, float(k), 1e9 + rng.gauss(0, 1), rng.gauss(0, 1)])
    rows = [[cell(k) if k < 5 else [7.0, 7.0 if n % 2 else None, math.nan if n == 3 else 1.0 * n][k - 5] for k in range(8)] for n in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{k}` double" for k in range(8))).repartition(5)
    for zero in (False, True):
        few = sorted(map(repr, p.profile_correlations(df, df.columns, zero).collect()))
        monkeypatch.setattr(p, "FEW_PAIRS", 0)
        assert sorted(map(repr, p.profile_correlations(df, df.columns, zero).collect())) == few
        monkeypatch.setattr("gaugeworks.functions.gram.BLOCK", 3)
        assert sorted(map(repr, p.profile_correlations(df, df.columns, zero).collect())) == few
        monkeypatch.undo()
    assert len(few) == 28


def test_a_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (4.0, 5.0, math.nan)], "a double, b double, c double")
    assert [r["correlation"] for r in p.profile_correlations(df, ["a", "b"]).collect()] == [None]
    assert math.isnan(p.profile_correlations(df, ["a", "c"]).first()["correlation"])
    assert p.profile_correlations(df.limit(0), ["a", "b"]).first()["correlation"] is None


def test_three_hundred_columns_in_one_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 3))
    data = base @ rng.normal(size=(3, 300)) + rng.normal(size=(400, 300))
    names = [f"c{k}" for k in range(300)]
    pandas.DataFrame(data, columns=names).to_parquet(f"{tmp_path}/wide.parquet")
    df = spark.read.parquet(f"{tmp_path}/wide.parquet")
    found = p.profile_correlations(df, names).collect()
    want = np.corrcoef(data.T)
    assert len(found) == 300 * 299 // 2
    assert max(abs(r["correlation"] - want[int(r["column_a"][1:]), int(r["column_b"][1:])]) for r in found) < 1e-4


@pytest.mark.parametrize("exact", [True, False])
def test_outliers_of_nan_and_of_nothing(spark, exact):
    df = spark.createDataFrame([(float(k), None) for k in range(1, 10)] + [(math.nan, None), (100.0, None)], "a double, b double")
    found = {r["column"]: r for r in p.profile_outliers(df, ["a", "b"], exact).collect()}
    assert found["a"]["outlier_count"] == 2
    assert (found["b"]["q1"], found["b"]["lower_bound"], found["b"]["outlier_count"]) == (None, None, 0)


def quantile(values, share):
    values = sorted(values)
    return values[max(math.ceil(share * len(values)), 1) - 1]


@pytest.mark.parametrize("kind", ["uniform", "heavy", "constant", "few"])
def test_exact_quantiles_by_brute_force(spark, kind):
    rng = random.Random(5)
    draw = {
        "uniform": lambda: rng.uniform(-5, 5),
        "heavy": lambda: 7.0 if rng.random() < 0.4 else rng.paretovariate(0.5),
        "constant": lambda: 3.0,
        "few": lambda: float(rng.randrange(4)),
    }[kind]
    values = [draw() for _ in range(40_000)]
    shares = (0.01, 0.25, 0.5, 0.5001, 0.75, 0.999)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    (row,) = exact_quantiles(df, ["v"], shares)[0].collect()
    assert row["quantiles"] == [quantile(values, s) for s in shares]


def test_exact_quantiles_ends_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.nan,), (4.0,), (None,)], "v double")
    (row,) = exact_quantiles(df, ["v"], (0.0, 0.25, 0.5, 0.75, 1.0))[0].collect()
    assert row["quantiles"][:4] == [1.0, 1.0, 2.0, 4.0]
    assert math.isnan(row["quantiles"][4])


@pytest.mark.parametrize("share", [0.01, 0.1, 0.6])
def test_many_nan_rank_above_every_number(spark, share):
    rng = random.Random(11)
    values = [math.nan if rng.random() < share else rng.gauss(0, 3) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "`a.b` double").repartition(5)
    shares = (0.0, 0.25, 0.399, 0.5, 0.75, 1.0)
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    want = [ordered[max(math.ceil(s * len(values)), 1) - 1] for s in shares]
    (row,) = exact_quantiles(df, ["a.b"], shares)[0].collect()
    assert repr(row["quantiles"]) == repr(want)
    (numeric,) = p.profile_numeric(df, ["a.b"], (0.25, 0.5, 0.75), exact=True).collect()
    (outlier,) = p.profile_outliers(df, ["a.b"], exact=True).collect()
    assert repr(numeric["quantiles"]) == repr([want[1], want[3], want[4]])
    if share < 0.25:
        low, high = outlier["lower_bound"], outlier["upper_bound"]
        assert outlier["outlier_count"] == sum(math.isnan(v) or v < low or v > high for v in values)


def test_ranks_outside_their_intervals_are_searched_again(spark, monkeypatch):
    from gaugeworks.functions import ranks

    sketch = ranks._Search.intervals
    monkeypatch.setattr(ranks._Search, "intervals", lambda self: sketch(self) if self.width > 1 else [(-9.0, -8.0)])
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"), F.lit(None).cast("double").alias("w"))
    rows = {r["column"]: r["quantiles"] for r in exact_quantiles(df, ["v", "w"], (0.5, 0.9))[0].collect()}
    assert rows == {"v": [2499.0, 4499.0], "w": [None, None]}
    assert [r["quantiles"] for r in exact_quantiles(df.limit(0), ["v"], (0.5,))[0].collect()] == [[None]]


TYPED = {
    "bigint": lambda rng: rng.choice([2**53 + rng.randrange(50), -(2**62) + rng.randrange(3), 7, rng.randrange(-(2**63), 2**63)]),
    "decimal(38,10)": lambda rng: Decimal(rng.randrange(10**25)).scaleb(-10) if rng.random() < 0.5 else Decimal(2**60 + rng.randrange(9)),
    "decimal(12,2)": lambda rng: Decimal(rng.randrange(-(10**8), 10**8)).scaleb(-2),
    "date": lambda rng: dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(9000)),
    "timestamp": lambda rng: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(10**rng.choice([2, 12]))),
    "timestamp_ntz": lambda rng: dt.datetime(1901, 1, 1) + dt.timedelta(microseconds=rng.randrange(10**15)),
    "smallint": lambda rng: rng.randrange(-5, 5),
}


def test_quantiles_keep_the_digits_of_their_type(spark):
    rng = random.Random(8)
    rows = [tuple(None if rng.random() < 0.02 else draw(rng) for draw in TYPED.values()) for _ in range(20_000)]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} {kind}" for k, kind in enumerate(TYPED))).repartition(6)
    shares = (0.0, 0.003, 0.25, 0.5, 0.77, 0.9999, 1.0)
    found = {(r["column"], r["share"]): r["value"] for r in p.profile_quantiles(df, df.columns, shares).collect()}
    for k, kind in enumerate(TYPED):
        values = [r[k] for r in rows if r[k] is not None]
        want = spark.createDataFrame([(n, quantile(values, s)) for n, s in enumerate(shares)], f"n int, v {kind}")
        text = {r["n"]: r["t"] for r in want.select("n", F.col("v").cast("string").alias("t")).collect()}
        assert [found[f"c{k}", s] for s in shares] == [text[n] for n in range(len(shares))], kind


def test_full_brackets_are_narrowed_first(spark, monkeypatch):
    from gaugeworks.functions import ranks

    rng = random.Random(12)
    values = [rng.choice([rng.gauss(0, 1), 0.5, float(rng.randrange(3)), math.nan]) for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    shares = (0.0, 0.1, 0.25, 0.4, 0.7499, 1.0)
    whole, _ = exact_quantiles(df, ["v"], shares)
    narrowed = []
    narrow = ranks._narrow
    monkeypatch.setattr(ranks, "MOST", 5)
    monkeypatch.setattr(ranks, "_narrow", lambda typed, searches: (narrowed.append(1), narrow(typed, searches)))
    monkeypatch.setattr(ranks, "REACH", 0.01)
    again, _ = exact_quantiles(df, ["v"], shares)
    assert narrowed and repr(again.collect()) == repr(whole.collect())
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    assert repr(again.first()["quantiles"]) == repr([ordered[max(math.ceil(s * len(values)), 1) - 1] for s in shares])


@pytest.mark.parametrize("kind", ["normal", "heavy", "ends", "nan"])
def test_outliers_are_counted_with_the_quartiles(spark, kind):
    rng = random.Random(14)
    draw = {
        "normal": lambda: rng.gauss(0, 1),
        "heavy": lambda: rng.choice([0.0, 0.0, 0.0, rng.paretovariate(0.3), -1.5]),
        "ends": lambda: rng.choice([-math.inf, math.inf, 1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 4.0]),
        "nan": lambda: rng.choice([math.nan, rng.random()]),
    }[kind]
    values = [draw() for _ in range(8_000)] + [None]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, w int").repartition(3)
    (got,) = p.profile_outliers(df.drop("w"), ["v"], exact=True).collect()
    above = lambda a, b: (math.isnan(a) and not math.isnan(b)) or a > b
    low, high = got["lower_bound"], got["upper_bound"]
    numbers = [v for v in values if v is not None]
    assert got["outlier_count"] == sum(above(low, v) or above(v, high) for v in numbers)
    ordered = sorted(numbers, key=lambda v: (math.isnan(v), v))
    assert repr(got["q1"]) == repr(ordered[max(math.ceil(0.25 * len(numbers)), 1) - 1])


def test_sketched_quantiles_among_nan_are_nan(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, math.inf, math.nan, math.nan, math.nan]], "v double")
    (row,) = p.profile_numeric(df, ["v"], (0.25, 0.5, 0.75)).collect()
    assert row["quantiles"][:2] == [2.0, math.inf] and math.isnan(row["quantiles"][2])


def test_temporal_skips_absent_columns(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-03-01",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    rows = sorted(p.profile_temporal(df, ["d", "gone"]).collect())
    assert [(r["month"], r["n"], r["min_date"], r["max_date"]) for r in rows] == [
        ("2024-01", 1, "2024-01-31", "2024-03-01"),
        ("2024-03", 1, "2024-01-31", "2024-03-01"),
    ]
    assert p.profile_temporal(df, ["gone"]).count() == 0


def test_profile_needs_its_columns(rows):
    with pytest.raises(SchemaError):
        p.profile(rows, p.ProfileSpec(required=("gone",)))
    sections = p.profile(rows, p.ProfileSpec(numeric=("a", "b"), categorical=("kind",), target="label", dates=("day",)))
    for section in sections.values():
        section.collect()
    assert {"schema", "nulls", "duplicates", "numeric", "correlations", "outliers", "categorical", "target"} <= set(sections)


def test_ordering_helpers_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.choice([None, *range(40)]), k, None if rng.random() < 0.1 else k * 10) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, t int, k int, v int")
    slice_of = F.floor(F.col("t") / 5)
    lagged = {r["k"]: r["p"] for r in previous_value(df, ["g"], ["t", "k"], "v", slice_of, "p").collect()}
    numbered = {r["k"]: r["n"] for r in running_number(df, ["g"], ["t", "k"], slice_of, "n").collect()}
    for group in "ab":
        previous = None
        for n, (_, _, k, v) in enumerate(
            sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1
        ):
            assert (lagged[k], numbered[k]) == (previous, n)
            previous = v
