"""Gates and promotion decisions for many models at once.

Metrics live in a table with one row per (model, version); decisions are made
per row, so a thousand models cost one job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.errors import NotApprovedError
from gaugeworks.functions.columns import failing_codes

METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
# The default technical minima and limits.
MINIMA = {"accuracy": 0.6, "precision": 0.55, "recall": 0.55, "f1_score": 0.55, "roc_auc": 0.6}
MAX_REGRESSION = 0.01
MAX_INVALID = 0.01
_DIGITS = 6


@dataclass(frozen=True)
class PromotionPolicy:
    """Minima per metric, the metric that decides, and how far it may fall behind.

    ``missing`` says what an absent challenger metric means: ``fail`` rejects,
    ``skip`` leaves its minimum out (but at least one metric must be there).
    ``minimum_improvement`` is not part of the decision unless it is set.
    """

    minima: Mapping[str, float]
    primary_metric: str = "f1_score"
    max_regression: float = MAX_REGRESSION
    missing: str = "fail"
    minimum_improvement: float | None = None


def metric_gate(
    metrics: DataFrame,
    minima: Mapping[str, float],
    invalid_column: str | None = None,
    max_invalid: float = MAX_INVALID,
) -> DataFrame:
    """Each metric row with its failures and whether it passes.

    A missing metric fails; a missing share of invalid predictions does not.
    """
    checks = [(f"{name}:missing", F.col(name).isNotNull()) for name in minima]
    checks += [
        (f"{name}:below_minimum", F.col(name).isNull() | (F.col(name) >= minimum)) for name, minimum in minima.items()
    ]
    if invalid_column is not None and invalid_column in metrics.columns:
        share = F.col(invalid_column)
        checks.append(("invalid_predictions:above_maximum", share.isNull() | (share <= max_invalid)))
    return metrics.withColumn("failures", failing_codes(checks)).withColumn("passed", F.size("failures") == 0)


def pair_roles(
    metrics: DataFrame,
    model: str,
    role: Column,
    metric_columns: Sequence[str] = METRICS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Champion and challenger metrics of each model side by side, from one metrics table.

    ``carry`` names further columns to keep for both, such as version, run and
    commit. ``role`` is 'champion', 'challenger' or NULL and picks at most one row per
    model and role. One aggregation replaces a self-join; models without a
    challenger are left out.
    """
    sides = []
    for name in ("champion", "challenger"):
        mine = role == name
        sides.append(F.count_if(mine).alias(f"n_{name}"))
        sides += [F.max(F.when(mine, F.col(m))).alias(f"{name}_{m}") for m in (*metric_columns, *carry)]
    paired = metrics.groupBy(model).agg(*sides).where(F.col("n_challenger") > 0)
    return paired.withColumn("is_first_model", F.col("n_champion") == 0).drop("n_champion", "n_challenger")


def pair_tables(
    challengers: DataFrame,
    champions: DataFrame,
    model: str,
    metric_columns: Sequence[str] = METRICS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """:func:`pair_roles` for champions and challengers kept in two tables; a missing champion is allowed."""
    kept = (*metric_columns, *carry)
    left = challengers.select(model, *[F.col(c).alias(f"challenger_{c}") for c in kept])
    right = champions.select(
        model, *[F.col(c).alias(f"champion_{c}") for c in kept], F.lit(True).alias("__has_champion")
    )
    joined = left.join(right, model, "left")
    return joined.withColumn("is_first_model", F.col("__has_champion").isNull()).drop("__has_champion")


def recommend(pairs: DataFrame, policy: PromotionPolicy) -> DataFrame:
    """Add the decision to champion/challenger pairs.

    A challenger is promoted when it meets all minima and its primary metric is
    not below the champion's by more than the allowed regression. Without a
    champion only the minima count.
    """
    new, old = F.col(f"challenger_{policy.primary_metric}"), F.col(f"champion_{policy.primary_metric}")
    skip = policy.missing == "skip"
    passes, codes = F.lit(True), []
    for name, minimum in policy.minima.items():
        value = F.col(f"challenger_{name}")
        ok = value >= minimum
        ok = (value.isNull() | ok) if skip else F.coalesce(ok, F.lit(False))
        passes = passes & ok
        codes.append((name, ok))
    if skip:
        any_metric = F.coalesce(*[F.col(f"challenger_{n}") for n in policy.minima]).isNotNull() if policy.minima else F.lit(False)
        passes = passes & any_metric
    within = F.coalesce(new >= old - F.lit(policy.max_regression), old.isNull())
    improvement = F.round(new - old, _DIGITS)
    approved = passes & within
    if policy.minimum_improvement is not None:
        approved = approved & F.coalesce(improvement >= policy.minimum_improvement, old.isNull())
    return (
        pairs.withColumns(
            {
                "primary_metric": F.lit(policy.primary_metric),
                "champion_metric": old,
                "challenger_metric": new,
                "absolute_improvement": improvement,
                "relative_improvement": F.round(F.try_divide(improvement, old), _DIGITS),
                "absolute_failures": failing_codes(codes),
                "absolute_approval": passes,
                "regression_within_limit": within,
                "technical_approval": approved,
            }
        ).withColumn("recommendation", F.when(F.col("technical_approval"), F.lit("promote")).otherwise(F.lit("reject")))
    )


def enforce_approval(recommendations: DataFrame, model: str, shown: int = 20) -> None:
    """Raise when any model is rejected, with their number and the names of the first ``shown``."""
    rejected = recommendations.where(F.col("recommendation") != "promote").select(model)
    names = [str(row[0]) for row in rejected.orderBy(model).limit(shown).collect()]
    if names:
        count = len(names) if len(names) < shown else rejected.count()
        more = f" and {count - len(names)} more" if count > len(names) else ""
        raise NotApprovedError(f"{count} not approved: {', '.join(names)}{more}")


def metadata_problems(joined: DataFrame) -> DataFrame:
    """Check recommendation, run and approval of each model against each other.

    Expects ``recommendation``, ``technical_approval``, ``rec_version``,
    ``rec_run_id``, ``rec_commit``, ``run_version``, ``run_run_id``,
    ``run_commit``, ``approver``, ``approval_version`` and ``approval_run_id``.
    Versions are compared as text, and two absent values are equal.
    """

    def same(a: str, b: str, as_text: bool = False) -> Column:
        left, right = F.col(a), F.col(b)
        if as_text:
            left, right = left.cast("string"), right.cast("string")
        return left.eqNullSafe(right)

    checks = [
        ("not_recommended", F.col("recommendation") == "promote"),
        ("not_technically_approved", F.col("technical_approval")),
        ("version_differs_from_run", same("rec_version", "run_version", as_text=True)),
        ("run_id_differs_from_run", same("rec_run_id", "run_run_id")),
        ("commit_differs_from_run", same("rec_commit", "run_commit")),
        ("no_approver", F.coalesce(F.col("approver") != "", F.lit(False))),
        ("approval_version_differs_from_run", same("approval_version", "run_version", as_text=True)),
        ("approval_run_id_differs_from_run", same("approval_run_id", "run_run_id")),
    ]
    return joined.withColumn("problems", failing_codes(checks)).withColumn("consistent", F.size("problems") == 0)


def promotion_metadata_check(
    recommendations: DataFrame, runs: DataFrame, approvals: DataFrame, model: str
) -> DataFrame:
    """:func:`metadata_problems` over three tables with one row per model.

    ``recommendations`` has recommendation, technical_approval, version, run_id,
    commit; ``runs`` version, run_id, commit; ``approvals`` approver, version,
    run_id. A model without run or approval is kept and fails.
    """

    def named(df: DataFrame, prefix: str, columns: Sequence[str]) -> list[Column]:
        return [F.col(c).alias(f"{prefix}_{c}") for c in columns]

    rec = recommendations.select(
        model, "recommendation", "technical_approval", *named(recommendations, "rec", ("version", "run_id", "commit"))
    )
    run = runs.select(model, *named(runs, "run", ("version", "run_id", "commit")))
    approval = approvals.select(model, "approver", *named(approvals, "approval", ("version", "run_id")))
    return metadata_problems(rec.join(run, model, "left").join(approval, model, "left"))


def manifest_check(expected: DataFrame, actual: DataFrame, artifact: str) -> DataFrame:
    """Compare commit, run, version and SHA-256 of artifacts with what was validated.

    Both frames have ``git_commit``, ``run_id``, ``model_version`` and ``sha256``
    next to the artifact name. Only columns present in both are compared.
    """
    fields = [c for c in ("git_commit", "run_id", "model_version", "sha256") if c in expected.columns and c in actual.columns]
    right = actual.select(artifact, *[F.col(c).alias(f"actual_{c}") for c in fields])
    joined = expected.select(artifact, *fields).join(right, artifact, "left")
    checks = [(c, F.col(c).cast("string").eqNullSafe(F.col(f"actual_{c}").cast("string"))) for c in fields]
    return (
        joined.withColumn("mismatches", failing_codes(checks))
        .withColumn("intact", F.size("mismatches") == 0)
        .select(artifact, "mismatches", "intact")
    )


def file_digests(spark, path: str, whole_bytes: int = 64 << 20, piece_bytes: int = 8 << 20) -> DataFrame:
    """(path, sha256) of every file under a folder, hashed where the file is read.

    A file of up to ``whole_bytes`` is read into one row. A larger one, of any size,
    is opened by the task that has its name and hashed piece by piece, through the
    file systems that Arrow knows (local, HDFS, S3, GCS), by the same path. Spark
    lists no empty files, so these have no row.
    """

    def streamed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                # Hadoop writes "file:/a b", Arrow takes "file:///a%20b".
                system, local = fs.FileSystem.from_uri(quote(re.sub("^file:/(?!/)", "file:///", name), safe="/:@"))
                digest = hashlib.sha256()
                with system.open_input_stream(local, compression=None) as file:
                    while piece := file.read(piece_bytes):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["path", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    # Only names and lengths: no content is read for these.
    large = files.where(F.col("length") > whole_bytes).select("path")
    spread = large.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return small.unionByName(spread.mapInArrow(streamed, "path string, sha256 string"))
