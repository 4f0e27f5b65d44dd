"""Nearest neighbours by a block matrix join.

Queries and vectors are dealt into blocks of bounded size and every pair of
blocks is one tile. In a tile vectors are held as int8 with a scale each; the
product of two blocks gives all distances at once, each with a bound of its
error from the lengths of what rounding took away. Only pairs whose least
possible distance is under the k-th largest possible one are computed again
from the original vectors. A tile gives k rows a query at most, and heaps
merge them over the tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.base import blocks, partitions, stored, table

K = 10
EVERY = 100
QUERY_BLOCK = 2_048
VECTOR_BLOCK = 32_768
#: A tile returns k rows a query, so one of fewer vectors than this moves more than it leaves out.
LEAST_BLOCK = 1_024
_TILE = 4_096


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the vectors that take part: not null or zero, no null or non-finite component, not empty."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("key"), v.alias("v")).filter(F.col("v").isNotNull())
    return rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0) & F.col("key").isNotNull())


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of each row's rounding error."""
    scale = np.maximum(np.abs(v).max(axis=1) / 127, np.finfo(np.float64).tiny)
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    with np.errstate(over="ignore"):
        error = np.sqrt(((v - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def _length(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes.astype(np.float64) * scale[:, None]) ** 2).sum(axis=1)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares summed component by component in their order.

    Where the sum is beyond the range of a double, it is taken of components scaled down.
    """
    total = np.zeros(len(rows))
    with np.errstate(over="ignore"):
        for column in range(rows.shape[1]):
            total += (rows[:, column] - query[column]) ** 2
        found = np.sqrt(total)
        far = np.flatnonzero(~np.isfinite(found))
        if len(far):
            size = np.maximum(np.abs(rows[far]).max(axis=1), np.abs(query).max())
            found[far] = size * np.sqrt(((rows[far] / size[:, None] - query / size[:, None]) ** 2).sum(axis=1))
    return found


def tile(queries: np.ndarray, query_keys: np.ndarray, vectors: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, key, distance) of the k nearest keys of each query in this tile: exact, ties to the smaller key.

    Of several rows of one key the nearest counts.
    """
    repeated = len(np.unique(keys)) < len(keys)
    q_codes, q_scale, q_error = quantised(queries)
    q_length = _length(q_codes, q_scale)
    q_float = q_codes.astype(np.float32)
    best: list[list[tuple[float, int]]] = [[] for _ in queries]
    for start in range(0, len(vectors), _TILE):
        part, own = vectors[start : start + _TILE], keys[start : start + _TILE]
        codes, scale, error = quantised(part)
        length = _length(codes, scale)
        if repeated:
            by_key = np.argsort(own, kind="stable")
            firsts = np.nonzero(np.diff(own[by_key], prepend=own[by_key[0]] - 1))[0]
        # Products of int8 codes are whole numbers that float32 holds exactly up to 2**24, over 1,000 components.
        products = _products(q_float, codes)
        for row, query in enumerate(queries):
            with np.errstate(over="ignore", invalid="ignore"):
                near = q_length[row] + length - 2 * q_scale[row] * scale * products[row]
                near = np.sqrt(np.maximum(near, 0))
                slack = q_error[row] + error + 1e-9 * (1 + near) + 1e-7 * np.sqrt(q_length[row] + length)
            # Beyond the range of a double nothing is known of a distance, so it is computed.
            known = np.isfinite(near + slack)
            other = own != query_keys[row]
            least = np.where(other, np.where(known, near - slack, -np.inf), np.inf)
            most = np.where(other & known, near + slack, np.inf)
            if repeated:
                most = np.minimum.reduceat(most[by_key], firsts)
            limit = np.partition(most, k - 1)[k - 1] if len(most) > k else np.inf
            if len(best[row]) == k:
                limit = min(limit, -best[row][0][0])
            left = np.nonzero((least <= limit) & other)[0]
            if not len(left):
                continue
            exact = distances(part[left], query)
            if repeated:
                nearest_of: dict[int, tuple[float, int]] = {}
                for item in sorted([*best[row], *zip((-exact).tolist(), (-own[left]).tolist())], reverse=True):
                    if len(nearest_of) == k:
                        break
                    nearest_of.setdefault(item[1], item)
                best[row] = list(nearest_of.values())
                heapq.heapify(best[row])
                continue
            if len(left) > k:
                order = np.lexsort((own[left], exact))[:k]
                left, exact = left[order], exact[order]
            for d, key in zip(exact.tolist(), own[left].tolist()):
                item = (-d, -key)
                if len(best[row]) < k:
                    heapq.heappush(best[row], item)
                elif item > best[row][0]:
                    heapq.heapreplace(best[row], item)
    for row, heap in enumerate(best):
        for d, key in heap:
            yield int(query_keys[row]), -key, -d


def _products(queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    step = 1_000
    total = np.zeros((len(queries), len(codes)), np.float64)
    for at in range(0, queries.shape[1], step):
        total += queries[:, at : at + step] @ codes[:, at : at + step].astype(np.float32).T
    return total


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = rows.column("key").to_numpy()
    values = rows.column("v").combine_chunks()
    flat = values.flatten() if isinstance(values, pa.ListArray) else pa.concat_arrays([c.flatten() for c in values.chunks])
    return keys, flat.to_numpy().reshape(len(keys), -1)


def nearest(vectors: DataFrame, query: Callable[[Column], Column], k: int = K, key: str = "vec_id", vector: str = "embedding",
            query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows of each row whose key meets `query`.

    Nearness is the smallest Euclidean distance, computed in double precision on
    the original vectors; ties go to the smaller key. Rows with the query's own
    key are none of its candidates. Vectors that are null, zero, empty or hold a
    null or non-finite component, and rows with a null key, take no part; a query
    meets only vectors with as many components. Repeated rows of one key and
    vector count once. With fewer candidates than k all are returned, with none no row.
    """
    spark = vectors.sparkSession
    found = usable(vectors, key, vector).withColumn("size", F.size("v"))
    count = found.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(query(F.col("key")), 1)).alias("q")).first()
    wide = blocks(count["q"], query_block)
    deep = max(blocks(count["n"], vector_block), min(2 * partitions(spark), blocks(count["n"], LEAST_BLOCK)))
    dealt = F.monotonically_increasing_id()
    # Each query once, so that what merge() reads of one key does not grow with its copies.
    queries = found.filter(query(F.col("key"))).dropDuplicates(["key", "v"])
    queries = queries.withColumn("across", F.pmod(F.xxhash64("key", "v"), F.lit(wide)))
    queries = queries.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(deep - 1)))).select("size", "across", "down", "key", "v")
    rows = found.withColumn("down", F.pmod(F.xxhash64(dealt), F.lit(deep)).cast("int"))
    rows = rows.withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long")))).select("size", "across", "down", "key", "v")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            query_keys, query_values = _matrix(left)
            keys, values = _matrix(right)
            out = list(tile(query_values, query_keys, values, keys, k))
        columns = list(zip(*out)) if out else [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "key", "score"])

    by = ("size", "across", "down")
    tiles = queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(product, "query_id long, key long, score double")

    def merge(group: pa.Table) -> pa.Table:
        pairs = set(zip(group.column("score").to_pylist(), group.column("key").to_pylist()))
        top: list[tuple[float, int]] = []
        seen: set[int] = set()
        heap = list(pairs)
        heapq.heapify(heap)
        while heap and len(top) < k:
            d, other = heapq.heappop(heap)
            if other not in seen:
                seen.add(other)
                top.append((d, other))
        query_id = group.column("query_id")[0].as_py()
        return pa.table({
            "query_id": pa.array([query_id] * len(top), pa.int64()), "rank": pa.array(range(1, len(top) + 1), pa.int32()),
            "key": pa.array([o for _, o in top], pa.int64()), "score": pa.array([d for d, _ in top], pa.float64()),
        })

    merged = stored(tiles, "tiles").groupBy("query_id").applyInArrow(merge, "query_id long, rank int, key long, score double")
    return merged.withColumnRenamed("key", key)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda key: key % EVERY == 0)


ORACLES = {
    "op8_nearest_neighbours": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
)
SELECT * FROM r WHERE rank <= 10
"""
}
QUERIES = {"op8_nearest_neighbours": op8_nearest_neighbours}
