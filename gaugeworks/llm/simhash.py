"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that
differ in at most three bits differ in at most one bit in one of the segments,
so a lookup of the 33 values around each segment in a table of segments finds
every partner; the whole distance decides. Equal fingerprints are one row in
all of this, whatever the size of their group, and a fingerprint's links are
bounded by the number of values within three bits.

Linked fingerprints are joined into components by contraction: every node
points to the neighbour with the least hash of the round, edges move to the
nodes pointed to, and become fewer by a constant share each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.base import byte_words, run_hashes, slices, stored, table, texts

WIDTH = 3
BITS = 3
SEGMENT = 32
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Signed 64 bits; a bit is set if it is set in over half of the shingles' hashes. No words: zero."""
    total, counts = 0, np.zeros(64, np.int64)
    for hashes in run_hashes(map(byte_words, slices(text or "")), width):
        total += len(hashes)
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        counts += np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint of each row, one row in and one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for (t,) in texts([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp long")


def _ball(value: Column, segment: int) -> Column:
    """All values within one bit of a segment, each with the segment's number in the bits above."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k) for k in range(SEGMENT)])
    return F.transform(flips, lambda f: value.bitwiseXOR(f).bitwiseOR(F.lit(segment << SEGMENT)))


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of different values of `fp`, a < b, that differ in at most `bits` bits (0 to 3).

    `prints` holds each value once.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of one bit find distances up to 3")
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT)
    probes = prints.select(F.col("fp").alias("a"), F.explode(F.concat(_ball(low, 0), _ball(high, 1))).alias("slot"))
    index = prints.select(
        F.col("fp").alias("b"),
        F.explode(F.array(low, high.bitwiseOR(F.lit(1 << SEGMENT)))).alias("slot"),
    )
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return probes.join(index.hint("shuffle_hash"), "slot").filter(near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the same root for all nodes of a component."""
    edges = stored(edges, "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("v"))
        least = both.groupBy("node").agg(F.min(rank("other")).alias("m"))
        step = stored(least.select("node", F.least("m", rank("node"))["v"].alias("up")), "contraction")
        maps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(
            step.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b"
        )
        pair = moved.filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        edges = stored(pair.distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[-1].select("node", F.col("up").alias("root"))
    for step in reversed(maps[:-1]):
        above = found.withColumnsRenamed({"node": "up"})
        found = step.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return found


def classes(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root, component_id, first_rows) of the (key, fp) rows.

    root is the same for all of a component, component_id the least key in it
    (null where every key is null), first_rows how many rows have that key.
    """
    per = prints.groupBy("fp", "key").agg(F.count(F.lit(1)).alias("n"))
    least = F.min_by(F.struct("key", "n"), "key").alias("least")
    unique = per.groupBy("fp").agg(least, F.sum("n").alias("rows"))
    unique = unique.select("fp", F.col("least.key").alias("key"), F.coalesce("least.n", "rows").alias("n"))
    unique = stored(unique, "prints")
    root = components(links(unique.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = unique.join(root, "fp", "left").select("fp", "key", "n", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    tops = stored(rooted.groupBy("root").agg(F.min("key").alias("component_id")), "tops")
    marked = rooted.join(tops, "root")
    own = F.col("key").eqNullSafe(F.col("component_id"))
    counts = marked.groupBy("root").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("first_rows"))
    found = marked.join(stored(counts, "counts"), "root").select("fp", "root", "component_id", "first_rows")
    return stored(found, "classes")


def near_duplicates(docs: DataFrame, width: int = WIDTH, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: its key, fingerprint (16 hex digits) and component_id, the smallest key reachable.

    Null and empty texts, and texts of white space, have fingerprint zero and
    link like any other. Repeated rows come out as often as they went in. A row
    with a null key has the component of its fingerprint (null, if no row of the
    component has a key). Other columns of `docs` are not read. An empty table
    gives an empty result.
    """
    prints = stored(fingerprints(docs, width, key, text), "fingerprints")
    found = prints.join(classes(prints, bits).select("fp", "component_id"), "fp")
    return found.select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
