"""Rule and prediction metrics per time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import share
from gaugeworks.operators.rules import ROWS, Rule, counted_keys
from gaugeworks.operators.suite import QualitySuite

_SPREAD = 64


def windowed_rules(
    stream: DataFrame, rules: Sequence[Rule], event_time: str, width: str, slide: str | None = None
) -> DataFrame:
    """The suite's verdict rows for every window of event time.

    Takes the same rules as the batch suite. The stream must carry a watermark; a
    window is final, and in append mode emitted, once the watermark has passed its
    end, and rows that come later are dropped.

    Rules that need a shuffle of their own (duplicates, cardinality, a domain or
    reference table) keep a count per window and key, and from these, when the
    window is final, one row per window. Rules on equal keys share that state, and
    rules on the row count alone take it from there; each other key set is an
    aggregation of its own over the stream. The tables are read anew for every batch.
    A checkpoint goes with the list of rules it was written for.
    """
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    passes: dict[str | tuple[str, ...] | None, list[tuple[int, Rule]]] = {}
    for position, rule in enumerate(rules, start=1):
        passes.setdefault(rule.counted.keys if rule.counted else rule.frame_key, []).append((position, rule))
    first = next((key for key in passes if isinstance(key, tuple)), None)
    if first is not None and not any(rule.aggregates for _, rule in passes.get(None, ())):
        passes[first] = passes.pop(None, []) + passes[first]
    results = None
    for number, (key, members) in enumerate(passes.items()):
        if key is None:
            rows = stream.groupBy(window).agg(*QualitySuite.aggregates([rule for _, rule in members]))
        else:
            # Spark 4.1 loses the watermark of an aggregation that shares its exchange with an equal one of
            # another pass and then never ends its windows. A number that can't be folded keeps them apart.
            apart = F.when(F.col(event_time).isNull(), -1).otherwise(number).alias("__pass")
            counted = [rule for _, rule in members if rule.counted]
            rows = counted_keys(stream, counted, (window, apart)) if counted else members[0][1].frame(stream, (window, apart))
        bounded = rows.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
        part = QualitySuite.verdicts(bounded, members, ("window_start", "window_end"))
        results = part if results is None else results.unionByName(part)
    return results


def windowed_predictions(
    stream: DataFrame,
    event_time: str,
    width: str,
    slide: str,
    prediction: str = "prediction",
) -> DataFrame:
    """Rows, positive rate and rate of missing predictions per sliding window."""
    p = F.col(prediction)
    rows = stream.groupBy(F.window(event_time, width, slide)).agg(
        F.count(F.lit(1)).alias(ROWS),
        F.count_if(p == 1.0).alias("positives"),
        F.count_if(p.isNull()).alias("missing"),
    )
    n = F.col(ROWS)
    return rows.select(
        F.col("window.start").alias("window_start"),
        n.alias("row_count"),
        F.round(share(F.col("positives"), n), 4).alias("positive_rate"),
        F.round(share(F.col("missing"), n), 4).alias("error_rate"),
    )


def deduplicated(stream: DataFrame, keys: Sequence[str], spread: Column | None = None) -> DataFrame:
    """The first row of each key among rows no further apart than the watermark delay.

    Copies of a row all go to the task that holds their key. When one key may have
    very many copies, ``spread`` names something they differ in, such as the file
    they came from: copies are first reduced to one per value of it, in as many
    tasks, and then to one per key. That keeps state for both steps.
    """
    if spread is None:
        return stream.dropDuplicatesWithinWatermark(list(keys))
    part = F.pmod(F.xxhash64(spread), F.lit(_SPREAD))
    reduced = stream.withColumn("__part", part).dropDuplicatesWithinWatermark([*keys, "__part"])
    return reduced.drop("__part").dropDuplicatesWithinWatermark(list(keys))
