"""Batch scoring with provenance, and the check of a scored sample."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.errors import RegistryError, SchemaError, ScoringError
from gaugeworks.operators.evaluation import positive_probability
from gaugeworks.operators.features import impute
from gaugeworks.operators.learning import load_model
from gaugeworks.operators.registry import version_by_alias

SCORE_COLUMNS = ("prediction", "probability_churn", "model_alias", "model_version", "scoring_timestamp")


@dataclass(frozen=True)
class Provenance:
    """Constants written next to every score."""

    alias: str
    scoring_timestamp: Column
    version: str | None = None
    run_id: str | None = None
    git_commit: str | None = None


def without_vectors(df: DataFrame) -> list[str]:
    """Names of the columns that are not ML vectors."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, VectorUDT)]


def score(
    df: DataFrame,
    model: PipelineModel,
    numeric: Sequence[str],
    categorical: Sequence[str],
    provenance: Provenance,
) -> DataFrame:
    """Predictions next to the input columns, one output row per input row.

    The model sees imputed values; the output keeps the values that came in.
    """
    missing = [c for c in (*numeric, *categorical) if c not in df.columns]
    if missing:
        raise SchemaError(f"scoring needs column(s) {', '.join(missing)}")
    if not df.isStreaming and df.isEmpty():
        raise ScoringError("there is nothing to score")
    kept = without_vectors(df)
    # Fields of the struct keep their NULLs while the columns themselves are filled.
    carried = df.select(F.struct(*kept).alias("__input"), *numeric, *categorical)
    out = model.transform(impute(carried, numeric, categorical))
    return out.select(
        "__input.*",
        F.col("prediction"),
        positive_probability(out).alias("probability_churn"),
        F.lit(provenance.alias).alias("model_alias"),
        F.lit(provenance.version or "unknown").alias("model_version"),
        F.lit(provenance.run_id or "unknown").alias("run_id"),
        provenance.scoring_timestamp.alias("scoring_timestamp"),
        F.lit(provenance.git_commit or "unknown").alias("git_commit"),
    )


def load_by_alias(versions: DataFrame, state: DataFrame, model_id, alias: str) -> tuple[PipelineModel, dict]:
    """The model behind an alias with its version record.

    ``versions`` has (model_id, version, run_id, path), ``state`` is the alias state.
    """
    version = version_by_alias(state, model_id, alias)
    record = versions.where((F.col("model_id") == model_id) & (F.col("version") == version)).first()
    if record is None:
        raise RegistryError(f"version {version} of model {model_id} is not registered")
    return load_model(record["path"]), record.asDict()


def smoke_check(
    scored: DataFrame,
    required: Sequence[str] = SCORE_COLUMNS,
    prediction: str = "prediction",
    score: str | None = None,
) -> DataFrame:
    """One row: rows, missing columns, NULL predictions, NaN scores, and whether all is well.

    On stored scores a NULL prediction shows a failed run; on fresh ones a NaN
    score is what a bad feature vector leaves behind.
    """
    missing = [c for c in required if c not in scored.columns]
    nulls = F.count_if(F.col(prediction).isNull()) if prediction in scored.columns else F.lit(0).cast("bigint")
    nans = F.count_if(F.isnan(F.col(score))) if score is not None else F.lit(0).cast("bigint")
    row = scored.agg(F.count(F.lit(1)).alias("row_count"), nulls.alias("null_predictions"), nans.alias("nan_scores"))
    passed = (F.col("row_count") > 0) & (F.col("null_predictions") == 0) & (F.col("nan_scores") == 0)
    return row.select(
        "row_count",
        F.lit(",".join(sorted(missing))).alias("missing_columns"),
        "null_predictions",
        "nan_scores",
        (passed & F.lit(not missing)).alias("passed"),
    )
