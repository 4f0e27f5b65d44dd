"""Evaluation, training, scoring and comparison queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import evaluation as e
from gaugeworks.operators import features as f
from gaugeworks.operators import registry as g
from gaugeworks.operators import scoring as sc
from gaugeworks.operators.learning import DEFAULTS, ModelSpec, load_model, save_model, train
from gaugeworks.operators.promotion import MINIMA, PromotionPolicy, pair_roles, recommend
from gaugeworks.plans import inputs as i
from gaugeworks.plans.sql import over
from gaugeworks.workspace import fresh_path

LOGISTIC = ModelSpec(i.NUMERIC, i.CATEGORICAL, "churn")
FOREST = ModelSpec(i.NUMERIC, i.CATEGORICAL, "churn", "random_forest")


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return f.prepare_datasets(
        i.churn(spark, sf_dir), key="customer_id", numeric=i.NUMERIC, categorical=i.CATEGORICAL, label="churn"
    )


_STATE = "model_id string, champion_version bigint, previous_champion_version bigint, challenger_version bigint"


def _trained(spec: ModelSpec):
    """What a fit must satisfy on unseen rows, next to their number, which SQL knows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        training, validation, _ = _splits(spark, sf_dir)
        model = train(training, spec)
        return e.evaluate_model(model, validation, spec.label).select(
            "row_count", "invalid_count", (F.col("roc_auc") > 0.75).alias("ranks_well"),
            F.lit(_fitted(model, training, spec)).alias("fitted"),
        )

    return query


def _fitted(model: PipelineModel, training: DataFrame, spec: ModelSpec) -> bool:
    """Whether a forest has its trees and depth, and a logistic model no slope left in its regularised loss.

    The slope of each coefficient is the mean of (probability - label) times the
    feature, plus the penalty on the coefficient; features are scaled to deviation 1.
    """
    last = model.stages[-1]
    if isinstance(last, RandomForestClassificationModel):
        return last.getNumTrees == DEFAULTS[spec.algorithm]["num_trees"][1] and max(t.depth for t in last.trees) <= 5
    rows = model.transform(training).select(
        vector_to_array("features").alias("x"), (F.element_at(vector_to_array("probability"), 2) - F.col(spec.label)).alias("miss")
    )
    coefficients = list(last.coefficients)
    slopes = rows.agg(*[F.avg(F.col("miss") * F.col("x")[k]) for k in range(len(coefficients))], F.avg("miss"), *[
        F.stddev(F.col("x")[k]) for k in range(len(coefficients))
    ]).first()
    count, penalty = len(coefficients), DEFAULTS[spec.algorithm]["reg_param"][1]
    slope = [slopes[k] + penalty * c * slopes[count + 1 + k] ** 2 for k, c in enumerate(coefficients)]
    return max(abs(v) for v in [*slope, slopes[count]]) < 1e-3


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.classification_metrics(i.scored(spark, sf_dir))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.confusion_matrix(i.scored(spark, sf_dir))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.roc_auc(i.scored(spark, sf_dir))


def roc_auc_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well price predicts a return, per supplier: many curves in one job."""
    lines = i.table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_extendedprice").alias("score"),
    )
    return e.roc_auc(lines, by=["l_suppkey"])


def invalid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.invalid_predictions(i.scored(spark, sf_dir))


def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.metrics_table(i.scored(spark, sf_dir))


def prediction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("score") >= 0.2, 1.0).otherwise(0.0)
    return e.prediction_agreement(i.scored(spark, sf_dir).withColumn("second", second), "prediction", "second")


def smoke_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.smoke_check(i.scored(spark, sf_dir), ("prediction", "score", "model_version"), score="score")


def evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-set metrics of a model that was saved and loaded, against a plain recount, with its size and latency."""
    training, _, test = _splits(spark, sf_dir)
    path = fresh_path(spark, "model")
    save_model(train(training, LOGISTIC), path)
    model = load_model(path)
    metrics = e.evaluate_model(model, test, LOGISTIC.label, "customer_id")
    recount = e.scored_by(model, test, LOGISTIC.label).agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6))
    return metrics.select(
        "row_count",
        "invalid_count",
        (F.col("accuracy") == recount.scalar()).alias("same_accuracy"),
        (F.round(1 - F.col("accuracy"), 6) == F.col("error_rate")).alias("same_error_rate"),
        F.col("roc_auc").between(0.75, 1.0).alias("ranks_well"),
        (F.col("latency_ms") > 0).alias("has_latency"),
        (e.model_size_bytes(spark, path).scalar() > 0).alias("has_size"),
    )


def _scored_batch(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, DataFrame]:
    training, _, _ = _splits(spark, sf_dir)
    model = train(training, LOGISTIC)
    provenance = sc.Provenance("champion", F.lit("2024-01-01 00:00:00").cast("timestamp"), "1", "run-1", "c0ffee")
    return model, sc.score(i.churn_dirty(spark, sf_dir), model, i.NUMERIC, i.CATEGORICAL, provenance)


def _by_hand(model: PipelineModel) -> Column:
    """The logistic model's probability from its coefficients and the stages' parameters, in plain arithmetic."""
    labels = dict(zip(i.CATEGORICAL, model.stages[0].labelsArray))
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in i.NUMERIC]
    values = [F.when(F.isnan(v), 0.0).otherwise(v) for v in values]
    for c in i.CATEGORICAL:
        known = F.coalesce(F.col(c), F.lit("unknown"))
        slots = [F.when(known == name, 1.0).otherwise(0.0) for name in labels[c]]
        values += slots
    scaler, last = model.stages[-2], model.stages[-1]
    margin = F.lit(float(last.intercept))
    for value, mean, std, weight in zip(values, scaler.mean, scaler.std, last.coefficients, strict=True):
        if std:
            margin = margin + (value - float(mean)) / float(std) * float(weight)
    return 1 / (1 + F.exp(-margin))


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's score against the one computed by hand."""
    model, rows = _scored_batch(spark, sf_dir)
    same = F.abs(F.col("probability_churn") - _by_hand(model)) < 1e-9
    label = F.when(F.col("probability_churn") > 0.5, 1.0).otherwise(0.0)
    return rows.select("customer_id", same.alias("same_probability"), (F.col("prediction") == label).alias("same_prediction"))


def train_promote_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, save, register, promote, and score with the model that the alias names."""
    training, _, _ = _splits(spark, sf_dir)
    path = fresh_path(spark, "registered")
    save_model(train(training, LOGISTIC), path)
    made = F.lit("2024-01-01 00:00:00").cast("timestamp")
    runs = spark.range(1).select(
        F.lit("churn").alias("model_id"), made.alias("ts"), F.lit(1).cast("bigint").alias("event_id"),
        F.lit("run-1").alias("run_id"), F.lit(path).alias("path"),
    )
    versions = g.register_versions(runs)
    candidates = versions.select("model_id", "version", F.lit(True).alias("consistent"))
    nothing = g.alias_state(g.promotion_events(g.promotion_plan(candidates, spark.createDataFrame([], _STATE)), made))
    plan = g.promotion_plan(candidates, nothing, confirm=True)
    state = g.alias_state(g.promotion_events(plan, made))
    model, record = sc.load_by_alias(versions, state, "churn", "champion")
    provenance = sc.Provenance("champion", made, str(record["version"]), record["run_id"])
    rows = sc.score(i.churn_dirty(spark, sf_dir), model, i.NUMERIC, i.CATEGORICAL, provenance)
    same = F.abs(F.col("probability_churn") - _by_hand(model)) < 1e-9
    return rows.select("customer_id", "model_alias", "model_version", "run_id", same.alias("same_probability"))


def score_batch_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scoring must not change: the input values, one row each, and the provenance."""
    _, rows = _scored_batch(spark, sf_dir)
    return rows.select(
        "customer_id",
        *i.NUMERIC,
        *i.CATEGORICAL,
        "model_alias",
        "model_version",
        F.col("probability_churn").between(0.0, 1.0).alias("has_probability"),
        F.col("prediction").isin(0.0, 1.0).alias("has_prediction"),
    )


def _two_models(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, PipelineModel, DataFrame]:
    training, _, test = _splits(spark, sf_dir)
    forest = ModelSpec(i.NUMERIC, i.CATEGORICAL, "churn", "random_forest", {"num_trees": 20})
    return train(training, LOGISTIC), train(training, forest), test


def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of both roles against a recount of the joined predictions."""
    champion, challenger, test = _two_models(spark, sf_dir)
    metrics = e.compare_models(champion, challenger, test, "customer_id", "churn")
    both = e.score_both(champion, challenger, test, "customer_id", "churn")
    recount = both.agg(*[F.round(F.avg((F.col(f"{r}_prediction") == F.col("label")).cast("int")), 6).alias(r) for r in ("champion", "challenger")])
    expected = recount.unpivot([], ["champion", "challenger"], "role", "expected")
    # Two rows.
    return metrics.join(F.broadcast(expected), "role").select(
        "role", "row_count", "invalid_count", (F.col("accuracy") == F.col("expected")).alias("same_accuracy"),
        F.col("roc_auc").between(0.75, 1.0).alias("ranks_well"),
    )


def champion_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models on the same test rows, then the promotion decision, against the rule spelled out."""
    metrics = e.compare_models(*_two_models(spark, sf_dir), "customer_id", "churn").withColumn("model_id", F.lit("churn"))
    policy = PromotionPolicy(MINIMA)
    decided = recommend(pair_roles(metrics, "model_id", F.col("role")), policy)
    best = metrics.where("role = 'challenger'")
    enough = F.lit(True)
    for name, least in MINIMA.items():
        enough = enough & (F.col(name) >= least)
    passes = best.agg(F.bool_and(enough)).scalar()
    promoted = F.col("recommendation") == "promote"
    return decided.select(
        "model_id", (promoted == F.col("technical_approval")).alias("follows_approval"),
        (~promoted | passes).alias("only_above_minima"),
    )


QUERIES = {
    fn.__name__: fn
    for fn in (
        classification_metrics,
        confusion_matrix,
        roc_auc,
        roc_auc_by_model,
        invalid_predictions,
        metrics_table,
        prediction_agreement,
        smoke_check,
        evaluate_model,
        score_batch,
        train_promote_score,
        score_batch_inputs,
        compare_models,
        champion_challenger,
    )
}
QUERIES["train_lr"] = _trained(LOGISTIC)
QUERIES["train_rf"] = _trained(FOREST)

_INVALID = """
SELECT COUNT(*) AS row_count, COUNT(*) FILTER (WHERE prediction IS NULL OR prediction NOT IN (0, 1)) AS invalid_count,
  ROUND(CAST(COUNT(*) FILTER (WHERE prediction IS NULL OR prediction NOT IN (0, 1)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 6)
    AS invalid_prediction_percentage
FROM scored
"""

_AUC_BY_SUPPLIER = """
SELECT l_suppkey, CASE WHEN SUM(pos) = 0 OR SUM(neg) = 0 THEN NULL ELSE
  ROUND(CAST(SUM(pos * (2 * (cum_neg - neg) + neg)) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE), 6) END AS roc_auc
FROM (SELECT l_suppkey, pos, neg,
        SUM(neg) OVER (PARTITION BY l_suppkey ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
      FROM (SELECT l_suppkey, l_extendedprice AS score, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS pos,
              COUNT(*) FILTER (WHERE l_returnflag <> 'R') AS neg FROM lineitem GROUP BY l_suppkey, l_extendedprice) g) w
GROUP BY l_suppkey
"""

_AGREEMENT = """
SELECT COUNT(*) AS n_compared, COUNT(*) FILTER (WHERE prediction = s) AS n_agree,
  ROUND(CAST(COUNT(*) FILTER (WHERE prediction = s) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 6) AS agreement_rate,
  COUNT(*) FILTER (WHERE prediction <> s AND prediction = label) AS only_first_right,
  COUNT(*) FILTER (WHERE prediction <> s AND s = label) AS only_second_right
FROM (SELECT label, prediction, CAST(CASE WHEN score >= 0.2 THEN 1 ELSE 0 END AS DOUBLE) AS s FROM scored) t
WHERE prediction IS NOT NULL
"""

_ROWS = "SELECT COUNT(*) AS row_count, CAST(0 AS BIGINT) AS invalid_count, {flags} FROM splits WHERE split = '{split}'"
_FITTED = over("splits", _ROWS.format(split="validation", flags="TRUE AS ranks_well, TRUE AS fitted"))

ORACLES = {
    "train_lr": _FITTED,
    "train_rf": _FITTED,
    "evaluate_model": over(
        "splits",
        _ROWS.format(
            split="test",
            flags="TRUE AS same_accuracy, TRUE AS same_error_rate, TRUE AS ranks_well, TRUE AS has_latency, TRUE AS has_size",
        ),
    ),
    "score_batch": over("churn_dirty", "SELECT customer_id, TRUE AS same_probability, TRUE AS same_prediction FROM churn_dirty"),
    "train_promote_score": over(
        "churn_dirty",
        "SELECT customer_id, 'champion' AS model_alias, '1' AS model_version, 'run-1' AS run_id, TRUE AS same_probability FROM churn_dirty",
    ),
    "compare_models": over(
        "splits",
        "SELECT role, t.* FROM (VALUES ('champion'), ('challenger')) r(role), ("
        + _ROWS.format(split="test", flags="TRUE AS same_accuracy, TRUE AS ranks_well")
        + ") t",
    ),
    "champion_challenger": "SELECT 'churn' AS model_id, TRUE AS follows_approval, TRUE AS only_above_minima",
    "classification_metrics": over("classification", "SELECT * FROM classification"),
    "confusion_matrix": over(
        "scored",
        "SELECT CAST(label AS DOUBLE) AS label, prediction, COUNT(*) AS n FROM scored WHERE prediction IS NOT NULL "
        "GROUP BY label, prediction",
    ),
    "roc_auc": over("auc", "SELECT * FROM auc"),
    "roc_auc_by_model": _AUC_BY_SUPPLIER,
    "invalid_predictions": over("scored", _INVALID),
    "metrics_table": over(
        "classification auc", "SELECT * FROM classification, auc, invalid", invalid=_INVALID
    ),
    "prediction_agreement": over("scored", _AGREEMENT),
    "smoke_check": over(
        "scored",
        "SELECT COUNT(*) AS row_count, 'model_version' AS missing_columns, COUNT(*) - COUNT(prediction) AS null_predictions, "
        "CAST(0 AS BIGINT) AS nan_scores, FALSE AS passed FROM scored",
    ),
    "score_batch_inputs": over(
        "churn_dirty",
        f"SELECT customer_id, {', '.join(i.NUMERIC)}, {', '.join(i.CATEGORICAL)}, 'champion' AS model_alias, "
        "'1' AS model_version, TRUE AS has_probability, TRUE AS has_prediction FROM churn_dirty",
    ),
}
