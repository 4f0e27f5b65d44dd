"""Incremental scoring and feature upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.operators.features import FeatureSpec, feature_lookup
from gaugeworks.operators.scoring import Provenance, score
from gaugeworks.sources.keyed import KeyedTable
from gaugeworks.streaming.sources import to_batches


def scored_stream(
    keys: DataFrame,
    features: DataFrame,
    spec: FeatureSpec,
    model: PipelineModel,
    numeric: Sequence[str],
    categorical: Sequence[str],
    provenance: Provenance,
) -> DataFrame:
    """Look up the features of arriving keys in a static table and score them."""
    looked_up = feature_lookup(keys, features, spec)
    return score(looked_up, model, numeric, categorical, provenance)


def upsert_stream(
    stream: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    source: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch into a keyed table.

    ``prepare`` reduces a batch to one row per key. A batch that is delivered again
    after a failure is recognised by its id and skipped.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare is not None else batch
        if not rows.isEmpty():
            table.upsert(rows, source=source, source_batch=batch_id)

    return to_batches(stream, handle, checkpoint)
