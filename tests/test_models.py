from __future__ import annotations

import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gaugeworks.errors import ConfigError, EvaluationError, FeatureError, SchemaError, ScoringError
from gaugeworks.operators import evaluation as e
from gaugeworks.operators import learning as ml
from gaugeworks.operators import scoring as sc
from gaugeworks.operators.features import prepare_datasets
from gaugeworks.plans import inputs as i


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        label = int(rng.random() < 0.3)
        # A third of the rows share one score.
        score = 0.5 if rng.random() < 0.33 else round(min(max(rng.gauss(0.4 + 0.2 * label, 0.2), 0.0), 1.0), 3)
        rows.append((f"m{k % 3}", label, float(score > 0.5), score))
    return spark.createDataFrame(rows, "model string, label int, prediction double, score double").cache()


def auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return round(won / (len(pos) * len(neg)), 6)


def test_auc_by_brute_force(scored):
    rows = scored.collect()
    assert e.roc_auc(scored).first()["roc_auc"] == auc([(r["label"], r["score"]) for r in rows])
    for row in e.roc_auc(scored, by=["model"]).collect():
        assert row["roc_auc"] == auc([(r["label"], r["score"]) for r in rows if r["model"] == row["model"]])


def test_metrics_equal_the_evaluators(scored):
    ready = scored.withColumn("label", F.col("label").cast("double")).withColumn(
        "raw", array_to_vector(F.array(1 - F.col("score"), "score"))
    )
    row = e.metrics_table(scored).first()
    multi = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    for ours, theirs in (
        ("accuracy", "accuracy"),
        ("precision", "weightedPrecision"),
        ("recall", "weightedRecall"),
        ("f1_score", "f1"),
    ):
        assert row[ours] == pytest.approx(multi.evaluate(ready, {multi.metricName: theirs}), abs=1e-6)
    exact = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="raw", numBins=0)
    assert row["roc_auc"] == pytest.approx(exact.evaluate(ready), abs=1e-6)
    assert row["error_rate"] == pytest.approx(1 - row["accuracy"], abs=1e-6)


def test_metrics_per_model(scored):
    per_model = {r["model"]: r for r in e.metrics_table(scored, by=["model"]).collect()}
    assert len(per_model) == 3
    alone = e.metrics_table(scored.where("model = 'm1'")).first()
    assert {k: per_model["m1"][k] for k in alone.asDict()} == alone.asDict()


def test_model_without_a_name_is_a_model(scored):
    unnamed = scored.withColumn("model", F.when(F.col("model") != "m1", F.col("model")))
    per_model = {r["model"]: r["roc_auc"] for r in e.metrics_table(unnamed, by=["model"]).collect()}
    assert per_model[None] == e.roc_auc(scored.where("model = 'm1'")).first()["roc_auc"]


def test_one_class_has_no_auc(scored):
    assert e.roc_auc(scored.where("label = 1")).first()["roc_auc"] is None


def test_predictions_off_the_labels_count_as_wrong(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 2.0), (0, 0.0), (1, None)], "label int, prediction double")
    row = e.classification_metrics(df).first()
    assert (row["accuracy"], row["recall"]) == (round(2 / 3, 6), round(2 / 3, 6))
    assert row["precision"] == 1.0


def test_invalid_predictions(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (0.5,), (0.0,)], "prediction double")
    assert e.invalid_predictions(df).first()["invalid_prediction_percentage"] == 0.6
    assert e.invalid_predictions(df.limit(0)).first()["invalid_prediction_percentage"] == 0.0


@pytest.fixture(scope="module")
def splits(spark, sf_dir):
    return prepare_datasets(
        i.churn(spark, sf_dir), key="customer_id", numeric=i.NUMERIC, categorical=i.CATEGORICAL, label="churn"
    )


SPEC = ml.ModelSpec(i.NUMERIC, i.CATEGORICAL, "churn", hyperparameters={"max_iter": 20})


@pytest.fixture(scope="module")
def model(splits):
    return ml.train(splits[0], SPEC)


def test_training_does_not_depend_on_partitioning(splits, model):
    again = ml.train(splits[0].repartition(5), SPEC)
    assert list(again.stages[-1].coefficients) == pytest.approx(list(model.stages[-1].coefficients), abs=1e-9)


def test_training_refusals(splits):
    with pytest.raises(EvaluationError):
        ml.train(splits[0].limit(0), SPEC)
    with pytest.raises(ConfigError):
        ml.estimator("no_such_algorithm", "y")
    with pytest.raises(FeatureError):
        ml.feature_stages([], [])


def test_defaults_of_the_estimators():
    lr, rf = ml.estimator("logistic_regression", "y"), ml.estimator("random_forest", "y")
    assert (lr.getMaxIter(), lr.getRegParam(), lr.getElasticNetParam()) == (50, 0.01, 0.0)
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getSeed()) == (100, 5, 42)


def test_unscaled_stages_and_unseen_categories(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "a")], "x double, c string")
    fitted = Pipeline(stages=ml.feature_stages(["x"], ["c"], scale=False)).fit(df)
    new = spark.createDataFrame([(5.0, "never seen"), (6.0, None)], "x double, c string")
    vectors = [list(r["features"].toArray()) for r in fitted.transform(new).collect()]
    assert vectors == [[5.0, 0.0, 0.0], [6.0, 0.0, 0.0]]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(7.0,), (7.0,)], "x double")
    fitted = Pipeline(stages=ml.feature_stages(["x"], [])).fit(df)
    assert {float(r["features"][0]) for r in fitted.transform(df).collect()} == {0.0}


def test_evaluation(splits, model):
    row = e.evaluate_model(model, splits[2], "churn").first()
    assert row["roc_auc"] > 0.75 and row["invalid_prediction_percentage"] == 0.0
    with pytest.raises(EvaluationError):
        e.evaluate_model(model, splits[2].limit(0), "churn")
    assert e.latency_ms(model, splits[2], "customer_id", repeats=1) > 0


def test_saved_model_and_its_size(spark, splits, model, tmp_path):
    path = str(tmp_path / "model")
    ml.save_model(model, path)
    loaded = ml.load_model(path)
    before = [r["prediction"] for r in model.transform(splits[2]).orderBy("customer_id").collect()]
    assert [r["prediction"] for r in loaded.transform(splits[2]).orderBy("customer_id").collect()] == before
    assert e.model_size_bytes(spark, path).first()["model_size_bytes"] > 1000


def provenance():
    return sc.Provenance("champion", F.lit("2024-01-01 00:00:00").cast("timestamp"), "3", "run-9", "c0ffee")


def test_scoring_keeps_the_input(spark, sf_dir, model):
    dirty = i.churn_dirty(spark, sf_dir)
    rows = sc.score(dirty, model, i.NUMERIC, i.CATEGORICAL, provenance())
    assert rows.columns[: len(dirty.columns)] == dirty.columns
    assert not [c for c, t in rows.dtypes if t == "vector"]
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count("total_charges").alias("charges"), F.count_if(F.isnan("probability_churn")).alias("nan")
    ).first()
    expected = dirty.agg(F.count(F.lit(1)), F.count("total_charges")).first()
    assert tuple(found) == (expected[0], expected[1], 0)
    first = rows.first()
    assert (first["model_alias"], first["model_version"], first["run_id"], first["git_commit"]) == ("champion", "3", "run-9", "c0ffee")
    assert sc.smoke_check(rows, score="probability_churn").first()["passed"]


def test_vectors_in_the_input_are_left_out(splits, model):
    vectors = model.transform(splits[2]).drop("prediction", "probability", "rawPrediction", "features_raw")
    names = {"contract_type_index", "contract_type_encoded", "internet_service_index", "internet_service_encoded", "features"}
    rows = sc.score(vectors.drop(*(names - {"features"})), model, i.NUMERIC, i.CATEGORICAL, provenance())
    assert "features" not in rows.columns and "probability_churn" in rows.columns


def test_scoring_refusals(spark, sf_dir, model):
    churn = i.churn(spark, sf_dir)
    with pytest.raises(SchemaError, match="tenure_months"):
        sc.score(churn.drop("tenure_months"), model, i.NUMERIC, i.CATEGORICAL, provenance())
    with pytest.raises(ScoringError):
        sc.score(churn.limit(0), model, i.NUMERIC, i.CATEGORICAL, provenance())


def test_without_imputation_a_missing_feature_gives_nan(spark, sf_dir, model):
    broken = i.churn(spark, sf_dir).limit(1).withColumn("total_charges", F.lit(None).cast("double"))
    row = model.transform(broken).select("probability", "prediction").first()
    assert math.isnan(row["probability"][1]) and row["prediction"] == 0.0


def test_smoke_check(spark):
    good = spark.createDataFrame([(1.0, 0.7)], "prediction double, p double")
    assert sc.smoke_check(good, ("prediction",)).first()["passed"]
    row = sc.smoke_check(good, ("prediction", "z", "a")).first()
    assert (row["missing_columns"], row["passed"]) == ("a,z", False)
    assert not sc.smoke_check(good.limit(0), ("prediction",)).first()["passed"]
    bad = spark.createDataFrame([(1.0, math.nan), (None, 0.1)], "prediction double, p double")
    row = sc.smoke_check(bad, ("prediction",), score="p").first()
    assert (row["null_predictions"], row["nan_scores"], row["passed"]) == (1, 1, False)


def test_comparison_on_the_same_rows(splits, model):
    both = e.compare_models(model, model, splits[2], "customer_id", "churn").collect()
    assert {r["role"] for r in both} == {"champion", "challenger"}
    assert both[0].asDict() | {"role": ""} == both[1].asDict() | {"role": ""}
    (alone,) = e.compare_models(None, model, splits[2], "customer_id", "churn").collect()
    assert alone["role"] == "challenger"
    pairs = e.score_both(model, model, splits[2], "customer_id", "churn")
    agreement = e.prediction_agreement(pairs, "champion_prediction", "challenger_prediction").first()
    assert (agreement["agreement_rate"], agreement["only_first_right"]) == (1.0, 0)
    with pytest.raises(EvaluationError):
        e.compare_models(None, model, splits[2].limit(0), "customer_id", "churn")


def test_provenance_of_a_model():
    assert SPEC.provenance() == {
        "version": "1",
        "numeric_columns": list(i.NUMERIC),
        "categorical_columns": list(i.CATEGORICAL),
        "label_column": "churn",
        "algorithm": "logistic_regression",
        "hyperparameters": {"max_iter": "20"},
    }


def test_model_behind_an_alias(spark, splits, model, tmp_path):
    from gaugeworks.errors import RegistryError

    path = str(tmp_path / "registered")
    ml.save_model(model, path)
    versions = spark.createDataFrame([(1, "2", "run-7", path)], "model_id int, version string, run_id string, path string")
    state = spark.createDataFrame([(1, "2", "9")], "model_id int, champion_version string, challenger_version string")
    loaded, record = sc.load_by_alias(versions, state, 1, "champion")
    assert record["run_id"] == "run-7"
    assert loaded.transform(splits[2]).count() == splits[2].count()
    with pytest.raises(RegistryError, match="9"):
        sc.load_by_alias(versions, state, 1, "challenger")


def test_dictionary_indexes_equal_the_indexer(spark):
    rng = random.Random(7)
    draw = lambda: rng.choice([None, "", "a", "B", "b", "é", *(f"v{int(rng.paretovariate(0.7)) % 400}" for _ in range(6))])
    rows = spark.createDataFrame([(k, draw(), draw()) for k in range(3000)], "k int, one string, two string").repartition(5)
    fitted = rows.where("k % 2 = 0")
    dictionary = ml.category_dictionary(fitted, ["one", "two"])
    found = ml.with_indexes(rows, dictionary, ["one", "two"]).select("k", "one_index", "two_index")
    indexer = StringIndexer(inputCols=["one", "two"], outputCols=["one_index", "two_index"], handleInvalid="keep").fit(fitted)
    assert sorted(found.collect()) == sorted(indexer.transform(rows).select("k", "one_index", "two_index").collect())


def test_a_million_categories(spark):
    rows = spark.range(0, 1_200_000, 1, 8).selectExpr("string(if(id < 200000, id * 5, id - 200000)) AS c")
    dictionary = ml.category_dictionary(rows, ["c"])
    row = dictionary.agg(F.count(F.lit(1)).alias("n"), F.max("index").alias("last"), F.countDistinct("index").alias("distinct")).first()
    assert tuple(row) == (1_000_000, 999_999.0, 1_000_000)
    # Those that come twice are first, in the order of their text.
    assert dictionary.where("index = 1").first()["value"] == "10" and dictionary.where("index = 200000").first()["value"] == "1"


def test_the_dictionary_of_no_rows(spark):
    rows = spark.createDataFrame([("a",), (None,)], "c string")
    found = ml.with_indexes(rows, ml.category_dictionary(rows.limit(0), ["c"]), ["c"]).collect()
    assert [r["c_index"] for r in found] == [0.0, 0.0]
