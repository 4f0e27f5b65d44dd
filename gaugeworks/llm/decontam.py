"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles.

An item's sketch is the smallest hashes of its shingles, so many that a
document holding the threshold's share of the item must hold one of them: of n
shingles at most n - ceil(t n) may be missing, so the n - ceil(t n) + 1
smallest can't all be. Nothing is lost, and a sketch is a fifth of its item at
the threshold 0.8. Items are partitioned by size, each partition doubling the
last one's; a document looks only into partitions whose smallest item it is
large enough to contain. What meets in a sketch is verified by counting the
item's shingles in the document.

The items' sketches go to every task while their total size is under a
bound; above it they are joined with the documents' shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gaugeworks.llm.base import fresh, portions, run_hashes, slices, stored, table, texts

WIDTH = 5
THRESHOLD = 0.8
#: Most shingles of all items together that are sent to every task: 8 bytes each and the sketches.
SENT_SHINGLES = 4_000_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")


def words(text: str) -> list[bytes]:
    """Runs of letters, digits and marks, lower-cased: punctuation and case don't hide a copy."""
    return [w.encode() for w in _WORD.findall(text.lower())]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes, sorted; of all words as one shingle, if there are fewer than `width`."""
    parts = [np.unique(h) for h in run_hashes(map(words, slices(text or "")), width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


@dataclass
class Partition:
    """Items of one size class: their sketch hashes, sorted, the item of each, and the least size of a document."""

    least: int
    hashes: np.ndarray
    owners: np.ndarray


def partitioned(items: list[np.ndarray], threshold: float) -> list[Partition]:
    by_class: dict[int, list[int]] = {}
    for k, own in enumerate(items):
        if len(own):
            by_class.setdefault(len(own).bit_length(), []).append(k)
    found = []
    for _, members in sorted(by_class.items()):
        sketches = [items[k][: len(items[k]) - needed(len(items[k]), threshold) + 1] for k in members]
        hashes = np.concatenate(sketches)
        owners = np.repeat(members, [len(s) for s in sketches])
        order = np.argsort(hashes, kind="stable")
        least = min(needed(len(items[k]), threshold) for k in members)
        found.append(Partition(least, hashes[order], owners[order]))
    return found


def contained(document: np.ndarray, items: list[np.ndarray], parts: list[Partition], threshold: float) -> list[tuple[int, int]]:
    """(item, shared shingles) of the items whose share in the sorted distinct hashes reaches the threshold."""
    met: set[int] = set()
    for part in parts:
        if len(document) < part.least:
            break
        low = np.searchsorted(part.hashes, document, "left")
        hit = low < len(part.hashes)
        hit[hit] = part.hashes[low[hit]] == document[hit]
        if hit.any():
            high = np.searchsorted(part.hashes, document[hit], "right")
            for a, b in zip(low[hit], high):
                met.update(part.owners[a:b].tolist())
    found = []
    for k in sorted(met):
        own = items[k]
        at = np.minimum(np.searchsorted(document, own), len(document) - 1)
        shared = int((document[at] == own).sum())
        if shared >= needed(len(own), threshold):
            found.append((k, shared))
    return found


def matches(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", most: int = SENT_SHINGLES,
) -> DataFrame:
    """(key, item key, shared, item_shingles, containment): the items that a document contains to the threshold.

    Compared are distinct shingles of lower-cased words. A text of fewer words
    than a shingle is one shingle of all of them, so a short item is found in
    documents of just its words. Null and empty texts have no shingles and match
    nothing. Repeated documents come out as often as they went in, repeated
    items once for each row. Other columns are not read.
    """
    hashed = stored(_hashed(items, width, item_key, item_text), "items")
    total = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
    if total <= most:
        return _sent(docs, hashed, width, threshold, key, text, item_key)
    return _joined(docs, hashed, width, threshold, key, text, item_key)


def _hashed(df: DataFrame, width: int, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingles(t, width).view(np.int64) for (t,) in texts([batch], "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.int64()))], ["number", "key", "hashes"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("number"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"number long, key {kind}, hashes array<bigint>")


def _collected(spark: SparkSession, hashed: DataFrame, threshold: float):
    rows = hashed.orderBy("number").collect()
    own = [np.array(r["hashes"], np.int64).view(np.uint64) for r in rows]
    parts = [(p.least, p.hashes, p.owners) for p in partitioned(own, threshold)]
    return spark.sparkContext.broadcast((own, parts))


def _sent(docs: DataFrame, hashed: DataFrame, width: int, threshold: float, key: str, text: str, item_key: str) -> DataFrame:
    spark = docs.sparkSession
    shared_items = _collected(spark, hashed.select("number", "hashes"), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, parts = shared_items.value
        parts = [Partition(*part) for part in parts]
        for batch in batches:
            rows, places, counts, sizes = [], [], [], []
            for row, (t,) in enumerate(texts([batch], "text")):
                for k, shared in contained(shingles(t, width), items, parts, threshold):
                    rows.append(row)
                    places.append(k)
                    counts.append(shared)
                    sizes.append(len(items[k]))
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, pa.int64()) for c in (places, counts, sizes)]], ["key", "place", "shared", "size"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = found.mapInArrow(run, f"key {kind}, place long, shared long, size long")
    keys = [r["key"] for r in hashed.orderBy("number").select("key").collect()]
    named = spark.createDataFrame(list(enumerate(keys)), f"place long, item {hashed.schema['key'].dataType.simpleString()}")
    return _named(found.join(F.broadcast(named), "place"), key, item_key)


def _joined(docs: DataFrame, hashed: DataFrame, width: int, threshold: float, key: str, text: str, item_key: str) -> DataFrame:
    """The same by joins: documents' hashes with sketches, then the pairs' whole shingle sets."""
    sized = hashed.withColumn("size", F.size("hashes").cast("long")).withColumn(
        "need", F.ceil(F.col("size") * threshold - 1e-9)
    )
    order = F.array_sort(F.transform("hashes", lambda h: F.struct(h.bitwiseXOR(F.lit(-(1 << 63))).alias("o"), h.alias("h"))))
    sketch = sized.select("number", "need", F.explode(F.slice(order, F.lit(1), (F.col("size") - F.col("need") + 1).cast("int"))["h"]).alias("hash"))
    own = stored(_hashed(docs, width, key, text), "documents")
    probes = own.select(F.col("number").alias("row"), F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    pairs = probes.join(sketch, "hash").filter("n >= need").select("row", "number").distinct()
    pairs = stored(pairs, "pairs")
    full = pairs.join(own.select(F.col("number").alias("row"), "key", F.col("hashes").alias("theirs")), "row").join(
        sized.select("number", F.col("key").alias("item"), "hashes", "size", "need"), "number"
    )
    shared = F.size(F.array_intersect("theirs", "hashes")).cast("long")
    return _named(full.withColumn("shared", shared).filter("shared >= need"), key, item_key)


def _named(found: DataFrame, key: str, item_key: str) -> DataFrame:
    return found.select(
        F.col("key").alias(key), F.col("item").alias(item_key), "shared", F.col("size").alias("item_shingles"),
        (F.col("shared") / F.col("size")).alias("containment"),
    )


def clean(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", most: int = SENT_SHINGLES,
) -> DataFrame:
    """The rows of `docs` that contain no item to the threshold, all columns; repeated rows share their fate."""
    spark = docs.sparkSession
    hashed = stored(_hashed(items, width, item_key, item_text), "items")
    if (hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0) > most:
        number = fresh(docs, "number")
        held = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        found = _joined(held, hashed, width, threshold, number, text, item_key)
        return held.join(found.select(number).distinct(), number, "left_anti").select(*docs.columns)
    shared_items = _collected(spark, hashed.select("number", "hashes"), threshold)
    dirty = fresh(docs, "dirty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, sketched = shared_items.value
        sketched = [Partition(*part) for part in sketched]
        for batch in portions(batches):
            flags = [bool(contained(shingles(t, width), items, sketched, threshold)) for (t,) in texts([batch], text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], [*batch.schema.names, dirty])

    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(dirty, BooleanType())]))
    return marked.filter(~F.col(dirty)).select(*docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_GRAMS = """
  SELECT {key} AS key, w, len(w) AS n FROM (
    SELECT {key}, regexp_extract_all(lower(COALESCE(text, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM {table}) x
"""
_SETS = """
  SELECT DISTINCT key, CASE WHEN n < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS gram
  FROM (SELECT key, w, n, unnest(range(1, greatest(n - 4, 1) + 1)) AS i FROM {words}) y WHERE n > 0
"""
ORACLES = {
    "op9_benchmark_decontamination": f"""
WITH dw AS ({_GRAMS.format(key="doc_id", table="documents")}), iw AS ({_GRAMS.format(key="item_id", table="benchmark")}),
d AS ({_SETS.format(words="dw")}), i AS ({_SETS.format(words="iw")}),
sizes AS (SELECT key, COUNT(*) AS size FROM i GROUP BY key)
SELECT d.key AS doc_id, i.key AS item_id, COUNT(*) AS shared, size AS item_shingles, COUNT(*) / CAST(size AS DOUBLE) AS containment
FROM d JOIN i USING (gram) JOIN sizes ON sizes.key = i.key GROUP BY d.key, i.key, size HAVING COUNT(*) >= 0.8 * size - 1e-9
"""
}
QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
