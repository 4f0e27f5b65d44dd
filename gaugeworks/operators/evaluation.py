"""Classification metrics over scored rows, for one model or many at once.

Every function takes ``by``, the columns that tell the models apart; without it
the whole frame is one model.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import EvaluationError
from gaugeworks.functions.columns import name_of, rows_from_sql, share, share_sql, struct_sql
from gaugeworks.functions.joins import join_null_safe
from gaugeworks.functions.ranks import beaten_pairs
from gaugeworks.workspace import fresh_path

DIGITS = 6
VALID_PREDICTIONS = (0.0, 1.0)
LATENCY_ROWS = 50


def _counts(scored: DataFrame, label: str, prediction: str, by: Sequence[str]) -> DataFrame:
    """Rows per (label, prediction), NULLs included; everything but the AUC follows from these few rows."""
    pairs = scored.select(
        *by, F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")
    )
    return pairs.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per (label, prediction); rows without a label or prediction are left out."""
    known = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    return _counts(scored.where(known), label, prediction, by)


def _invalid_sql(prediction: str) -> str:
    listed = ", ".join(f"{v}D" for v in VALID_PREDICTIONS)
    return f"({prediction} IS NULL OR {prediction} NOT IN ({listed}))"


def _metrics_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Label-weighted metrics and the share of invalid predictions.

    Each (label, prediction) count stands for its label, for its prediction and for
    its rows, so one aggregation per class and one over the classes give all of it.
    """
    known = "(label IS NOT NULL AND prediction IS NOT NULL)"
    none = "0L"

    def row(class_of: str, actual: str, predicted: str, hit: str, rows: str, invalid: str) -> str:
        return struct_sql(
            **{"class": class_of}, actual=actual, predicted=predicted, hit=hit, rows=rows, invalid=invalid
        )

    parts = [
        row("label", f"if({known}, n, 0L)", none, f"if({known} AND label = prediction, n, 0L)", none, none),
        row("prediction", none, f"if({known}, n, 0L)", none, none, none),
        row("double(NULL)", none, none, none, "n", f"if({_invalid_sql('prediction')}, n, 0L)"),
    ]
    per_class = (
        counts.select(*by, rows_from_sql(parts))
        .groupBy(*by, "class")
        .agg(*[F.expr(f"sum({c}) AS {c}") for c in ("actual", "predicted", "hit", "rows", "invalid")])
    )
    precision, recall = share_sql("hit", "predicted"), share_sql("hit", "actual")
    f1 = share_sql(f"2.0D * {precision} * {recall}", f"{precision} + {recall}")
    accuracy = "try_divide(double(sum(hit)), double(sum(actual)))"
    metrics = {
        "accuracy": accuracy,
        # A class without rows has weight zero.
        **{
            name: f"try_divide(sum(actual * {value}), double(sum(actual)))"
            for name, value in (("precision", precision), ("recall", recall), ("f1_score", f1))
        },
        "error_rate": f"1.0D - {accuracy}",
        "invalid_prediction_percentage": share_sql("sum(invalid)", "sum(rows)"),
    }
    return per_class.groupBy(*by).agg(
        *[F.expr(f"round({value}, {DIGITS}) AS {name_of(name)}") for name, value in metrics.items()],
        F.expr("coalesce(sum(rows), 0L) AS row_count"),
        F.expr("coalesce(sum(invalid), 0L) AS invalid_count"),
    )


def classification_metrics(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and label-weighted precision, recall and F1, plus the error rate."""
    metrics = _metrics_from_counts(_counts(scored, label, prediction, by), by)
    return metrics.select(*by, "accuracy", "precision", "recall", "f1_score", "error_rate")


def tally(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., label, prediction, score, n): the rows of each combination.

    All metrics follow from it. Used for several of them, it is planned for each but
    run once, since Spark reuses its exchange.
    """
    named = {"label": label, "prediction": prediction, "score": score}
    columns = [F.col(name_of(c)).alias(alias) for alias, c in named.items()]
    return scored.select(*by, *columns).groupBy(*by, *named).agg(F.count(F.lit(1)).alias("n"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL with one class only.

    Rows are counted per distinct score first, then ranked over score ranges, so
    neither a common score nor a long list of scores ends up in one task.
    """
    known = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return _auc(known.withColumn("n", F.lit(1).cast("bigint")), label, score, by)


def _auc(weighted: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """From rows that stand for ``n`` rows each."""
    by = list(by)
    known = weighted.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    positive = F.col(label).cast("double") > 0.5
    per_score = (
        known.select(*by, F.col(score).cast("double").alias("score"), positive.alias("__positive"), "n")
        .groupBy(*by, "score")
        .agg(
            F.expr("coalesce(sum(n) FILTER (WHERE __positive), 0L) AS pos"),
            F.expr("coalesce(sum(n) FILTER (WHERE NOT __positive), 0L) AS neg"),
        )
    )
    pairs = beaten_pairs(per_score, "score", by)
    auc = F.expr("try_divide(won, double(pos_total) * double(neg_total))")
    return pairs.select(*by, F.round(auc, DIGITS).alias("roc_auc"))


def invalid_predictions(scored: DataFrame, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions that are NULL, NaN or neither 0 nor 1."""
    n, bad = F.count(F.lit(1)), F.count_if(F.expr(_invalid_sql(name_of(prediction))))
    return scored.groupBy(*by).agg(
        n.alias("row_count"),
        bad.alias("invalid_count"),
        F.round(share(bad, n), DIGITS).alias("invalid_prediction_percentage"),
    )


def metrics_table(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    score: str = "score",
    by: Sequence[str] = (),
) -> DataFrame:
    """All metrics in one row per model: the ones from counts, the invalid share and the AUC."""
    return metrics_of(tally(scored, label, prediction, score, by), by)


def metrics_of(tallied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`metrics_table` of a :func:`tally`."""
    by = list(by)
    counts = tallied.groupBy(*by, F.col("label").cast("double"), F.col("prediction").cast("double")).agg(F.sum("n").alias("n"))
    metrics = _metrics_from_counts(counts.toDF(*by, "label", "prediction", "n"), by)
    auc = _auc(tallied, "label", "score", by)
    if by:
        return join_null_safe(metrics, auc, by, "left")
    return metrics.withColumn("roc_auc", auc.scalar())


def positive_probability(model_output: DataFrame, probability: str = "probability") -> Column:
    """Second entry of the probability vector, or NULL when the model gives none."""
    if probability not in model_output.columns:
        return F.lit(None).cast("double")
    return F.element_at(vector_to_array(F.col(probability)), 2)


def scored_by(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """(label, prediction, score) of a model on a frame; score is the positive probability."""
    out = model.transform(df)
    return out.select(
        F.col(label).cast("double").alias("label"), F.col("prediction"), positive_probability(out).alias("score")
    )


def model_size_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of a saved model, from file lengths alone; checksum and marker files do not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("model_size_bytes"))


def stable_sample(df: DataFrame, order: str, rows: int) -> DataFrame:
    """The first rows in the order of a column, the same ones in every run."""
    return df.orderBy(order).limit(rows)


def latency_ms(model: PipelineModel, df: DataFrame, order: str, repeats: int = 3, rows: int = LATENCY_ROWS) -> float:
    """Mean time to score a small sample; the rows go to a sink that keeps the model in the plan."""
    sample = stable_sample(df, order, rows)
    taken = []
    for _ in range(repeats):
        start = time.perf_counter()
        model.transform(sample).write.format("noop").mode("overwrite").save()
        taken.append((time.perf_counter() - start) * 1000)
    return round(sum(taken) / len(taken), 3)


def _kept(scored: DataFrame, purpose: str) -> DataFrame:
    """Scores written to the shared folder, so that the models see every row once; an error when there are none."""
    path = fresh_path(scored.sparkSession, "scores")
    scored.write.parquet(path)
    kept = scored.sparkSession.read.schema(scored.schema).parquet(path)
    if kept.isEmpty():
        raise EvaluationError(f"{purpose} on no rows")
    return kept


def evaluate_model(
    model: PipelineModel, df: DataFrame, label: str, latency_order: str | None = None
) -> DataFrame:
    """Metrics of a model on labelled rows, one row; with ``latency_order`` also the time to score a small sample.

    The rows are scored at once, each one time.
    """
    metrics = metrics_table(_kept(scored_by(model, df, label), "a model cannot be evaluated"))
    if latency_order is None:
        return metrics
    return metrics.withColumn("latency_ms", F.lit(latency_ms(model, df, latency_order)))


def compare_models(
    champion: PipelineModel | None, challenger: PipelineModel, df: DataFrame, key: str, label: str
) -> DataFrame:
    """Metrics of both models on the same rows, one row per role.

    The rows pass through one model after the other, so there is no join; they are
    scored at once, each one time by each model.
    """
    paired = _kept(score_both(champion, challenger, df, key, label), "models cannot be compared")
    roles = ["challenger"] if champion is None else ["champion", "challenger"]
    by_role = paired.select(
        "label",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("role"),
                        F.col(f"{r}_prediction").alias("prediction"),
                        F.col(f"{r}_score").alias("score"),
                    )
                    for r in roles
                ]
            )
        ),
    )
    return metrics_table(by_role, by=["role"])


def score_both(
    champion: PipelineModel | None, challenger: PipelineModel, df: DataFrame, key: str, label: str
) -> DataFrame:
    """(key, label, champion and challenger prediction and score) for every row."""
    kept = list(df.columns)
    frame = df
    added: list[str] = []
    for role, model in (("champion", champion), ("challenger", challenger)):
        if model is None:
            continue
        out = model.transform(frame)
        frame = out.select(
            *kept,
            *added,
            F.col("prediction").alias(f"{role}_prediction"),
            positive_probability(out).alias(f"{role}_score"),
        )
        added += [f"{role}_prediction", f"{role}_score"]
    return frame.select(key, F.col(label).cast("double").alias("label"), *added)


def prediction_agreement(scored: DataFrame, first: str, second: str, label: str = "label") -> DataFrame:
    """How often two predictions agree, and who is right where they do not."""
    a, b, y = F.col(first), F.col(second), F.col(label).cast("double")
    both = a.isNotNull() & b.isNotNull()
    n = F.count_if(both)
    agree = F.count_if(both & (a == b))
    return scored.agg(
        n.alias("n_compared"),
        agree.alias("n_agree"),
        F.round(share(agree, n), DIGITS).alias("agreement_rate"),
        F.count_if(both & (a != b) & (a == y)).alias("only_first_right"),
        F.count_if(both & (a != b) & (b == y)).alias("only_second_right"),
    )
