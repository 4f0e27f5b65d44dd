"""Derived features, imputation, the train/validation/test split and feature lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.errors import FeatureError
from gaugeworks.functions.columns import hash_bucket, ratio_or_null
from gaugeworks.functions.joins import lookup_join

MISSING_CATEGORY = "unknown"
SPLITS = ("train", "validation", "test")
_BUCKETS = 10_000


def customer_features(df: DataFrame, feature_timestamp: Column) -> DataFrame:
    """Average charge per month of tenure, support calls per month, and the run's timestamp.

    A tenure of zero or NULL falls back to the monthly charge; a divisor of zero
    gives NULL instead of failing the job.
    """
    tenure = F.col("tenure_months")
    return df.withColumns(
        {
            "avg_monthly_charge_ratio": F.when(tenure > 0, ratio_or_null(F.col("total_charges"), tenure)).otherwise(
                F.col("monthly_charges").cast("double")
            ),
            "support_calls_per_tenure_month": ratio_or_null(F.col("support_calls"), tenure + F.lit(1)),
            "feature_timestamp": feature_timestamp,
        }
    )


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """NULL and NaN numbers become 0, NULL strings become ``unknown``; types stay, absent columns are skipped."""
    fill: dict[str, float | str] = {c: 0.0 for c in numeric if c in df.columns}
    fill.update({c: MISSING_CATEGORY for c in categorical if c in df.columns})
    return df.fillna(fill) if fill else df


def label_as_double(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.col(label).cast("double"))


def split_column(key: Column, train: float, validation: float, test: float, seed: int) -> Column:
    """Name of the split a key belongs to; the same key lands in the same split in every job."""
    if abs(train + validation + test - 1.0) > 1e-6:
        raise FeatureError(f"split fractions must sum to 1, got {train + validation + test}")
    bucket = hash_bucket(key, seed, _BUCKETS)
    first, second = round(train * _BUCKETS), round((train + validation) * _BUCKETS)
    return (
        F.when(bucket < first, F.lit(SPLITS[0])).when(bucket < second, F.lit(SPLITS[1])).otherwise(F.lit(SPLITS[2]))
    )


def split_rows(
    df: DataFrame, key: str, train: float = 0.7, validation: float = 0.15, test: float = 0.15, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows, chosen by key and before anything is fitted."""
    marked = split_column(F.col(key), train, validation, test, seed)
    return tuple(df.where(marked == name) for name in SPLITS)


def prepare_datasets(
    df: DataFrame,
    *,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    train: float = 0.7,
    validation: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Impute, cast the label, split."""
    ready = label_as_double(impute(df, numeric, categorical), label)
    return split_rows(ready, key, train, validation, test, seed)


@dataclass(frozen=True)
class FeatureSpec:
    """A feature table: its name, keys and feature columns."""

    table: str
    keys: tuple[str, ...]
    features: tuple[str, ...]
    timestamp: str = "feature_timestamp"

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.features]


def training_set(
    labels: DataFrame, features: DataFrame, spec: FeatureSpec, label: str, hot_share: float | None = None
) -> DataFrame:
    """Labels with the features of their key; labels without features are left out.

    ``features`` has one row per key, which a keyed table guarantees.
    """
    wanted = labels.select(*spec.keys, label)
    return lookup_join(wanted, features.select(*spec.columns), spec.keys, "inner", hot_share)


def unmatched_labels(labels: DataFrame, features: DataFrame, spec: FeatureSpec) -> DataFrame:
    """How many label rows a training set leaves out, one row."""
    per_key = labels.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    known = features.select(*spec.keys).distinct()
    return per_key.join(known, list(spec.keys), "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_unmatched"), F.count(F.lit(1)).alias("n_unmatched_keys")
    )


def feature_lookup(
    keys_df: DataFrame, features: DataFrame, spec: FeatureSpec, hot_share: float | None = None
) -> DataFrame:
    """Rows with the features of their key; a key without features keeps NULLs."""
    return lookup_join(keys_df, features.select(*spec.columns), spec.keys, "left", hot_share)
