"""Substring dedup by fixed-block anchors: passages that an earlier document has as well are removed.

A passage counts from `window` words on. Every such window holds a whole block
of its document's words, cut at multiples of half the window. These blocks are
the anchors: each document's rolling windows of a block's length are looked up
among the blocks of all documents. An anchor that hits is extended word by word
to both sides as long as the rolling windows recur in another document; from
the maximal stretches so found, each window of full length is compared by its
words' 128-bit hash, and one is removed if a document with a smaller key has it.

Documents are gathered into chunks that are stored once, bucketed by chunk, and
read from there in each of three passes, so texts are never shuffled. A chunk
sends each distinct hash once, packed with those of its bucket, with two bits:
whether the hash is a block's and whether two of its documents have it. So a
passage that a third of all documents share is one entry per chunk in all
exchanges. What comes back to a chunk is a bit or two for each hash it sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.base import blocks, partitions, stored, table
from gaugeworks.workspace import fresh_path

WINDOW = 13
#: Words of the documents in one chunk; a longer document is a chunk of its own.
CHUNK_WORDS = 1 << 17
#: Characters of all texts for each bucket of hashes: what one task sorts at a time is about their number of words.
BUCKET_CHARS = 1 << 24
#: The key that stands for null: after all others.
_LAST = (1 << 63) - 1
_VALUE_BITS = 38
_R = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _MIX[0]
    h = (h ^ h >> np.uint64(27)) * _MIX[1]
    return h ^ h >> np.uint64(31)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            one, inverse = np.full(n, _R, np.uint64), np.full(n, pow(_R, -1, 1 << 64), np.uint64)
            one[0] = inverse[0] = 1
            self.up, self.down = np.multiply.accumulate(one), np.multiply.accumulate(inverse)
        return self.up, self.down


class Chunk:
    """Documents of some words each: `data` holds the words, one byte of white space after each, a line a document."""

    def __init__(self, data: bytes, keys: np.ndarray, window: int, powers: _Powers):
        self.data, self.window, self.block = data, window, (window + 1) // 2
        raw = np.frombuffer(data, np.uint8)
        self.ends = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))
        full = self.ends > self.starts  # an empty document is an empty line
        line = np.cumsum(raw[self.ends] == 0x0A) - (raw[self.ends] == 0x0A)
        self.starts, self.ends, self.owner = self.starts[full], self.ends[full], line[full]
        self.keys = keys[self.owner]
        self.sizes = np.bincount(self.owner, minlength=len(keys))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.rolling = self._rolling(raw, powers)

    def __len__(self) -> int:
        return len(self.starts)

    def _rolling(self, raw: np.ndarray, powers: _Powers) -> np.ndarray:
        """A 64-bit hash of the block that starts at each word."""
        count = len(self) - self.block + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        words = np.empty(len(self), np.uint64)
        low = 0
        while low < len(self):
            # Pieces of bounded length, so that the powers are.
            high = max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + (1 << 22), "right")))
            base = self.starts[low]
            piece = raw[base : self.ends[high - 1]]
            up, down = powers.upto(len(piece) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)])))
            s, e = self.starts[low:high] - base, self.ends[low:high] - base
            words[low:high] = (sums[e] - sums[s]) * down[s]
            low = high
        words = _mixed(words)
        rolled = np.zeros(count, np.uint64)
        for k in range(self.block):
            rolled = rolled * np.uint64(_R) + words[k : k + count]
        return _mixed(rolled)

    def inside(self, width: int) -> np.ndarray:
        """Words at which a stretch of `width` words of one document starts."""
        if len(self) < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.owner[: len(self) - width + 1] == self.owner[width - 1 :])

    def anchors(self, buckets: int) -> Entries:
        """The distinct hashes of all rolling windows, by bucket."""
        at = self.inside(self.block)
        h = self.rolling[at]
        bucket = (h >> np.uint64(_VALUE_BITS)) % np.uint64(buckets)
        key = bucket << np.uint64(_VALUE_BITS) | h & np.uint64((1 << _VALUE_BITS) - 1)
        order = np.argsort(key, kind="stable")
        first = _firsts(key[order])
        owner = self.owner[at][order]
        last = np.append(first[1:], len(order)) - 1
        many = owner[first] != owner[last] if len(first) else np.zeros(0, bool)
        aligned = (at - self.first[self.owner[at]]) % self.block == 0
        block = np.logical_or.reduceat(aligned[order], first) if len(first) else np.zeros(0, bool)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        found = key[order][first]
        return Entries(at, entry, (found >> np.uint64(_VALUE_BITS)).astype(np.int64), found & np.uint64((1 << _VALUE_BITS) - 1), many, block)

    def candidates(self, anchors: Entries, recurs: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Starts of the full windows inside the stretches to which the anchors that hit are extended."""
        seen, met = np.zeros(len(self) + 1, np.int64), np.zeros(len(self) + 1, np.int64)
        seen[anchors.at + 1], met[anchors.at + 1] = recurs[anchors.entry], hit[anchors.entry]
        seen, met = np.cumsum(seen), np.cumsum(met)
        at = self.inside(self.window)
        steps = self.window - self.block + 1
        return at[(seen[at + steps] - seen[at] == steps) & (met[at + steps] > met[at])]

    def windows(self, at: np.ndarray, buckets: int) -> Windows:
        """The distinct contents of the windows that start at `at`, by bucket, each with the least key that has it."""
        view, digest = memoryview(self.data), xxhash.xxh3_128_digest
        spans = zip(self.starts[at].tolist(), self.ends[at + self.window - 1].tolist())
        parts = np.frombuffer(b"".join([digest(view[s:e]) for s, e in spans]), ">u8").astype(np.uint64).reshape(-1, 2)
        high, low = parts[:, 0], parts[:, 1]
        bucket = (high % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.keys[at], high, low, bucket))
        first = _firsts(bucket[order], low[order], high[order])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        top = order[first]
        return Windows(at, entry, bucket[top], low[top], high[top], self.keys[at][top])

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Which words are in a window that starts at `at`."""
        marks = np.zeros(len(self) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + self.window, -1)
        return np.cumsum(marks[:-1]) > 0

    def spans(self, covered: np.ndarray, document: int) -> np.ndarray:
        """(start, length) of the maximal covered stretches of a document."""
        own = covered[self.first[document] : self.first[document + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
        return np.stack([edges[::2], edges[1::2] - edges[::2]], 1)

    def kept(self, spans: np.ndarray, document: int) -> bytes:
        """The document's words outside the spans, joined by a space."""
        base, parts, at = self.first[document], [], 0
        for start, length in [*spans.tolist(), (int(self.sizes[document]), 0)]:
            if start > at:
                parts.append(self.data[self.starts[base + at] : self.ends[base + start - 1]])
            at = start + length
        return b" ".join(parts)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


@dataclass
class Entries:
    """Distinct hashes of a chunk: which entry each rolling window at `at` is, and of each entry its bucket, value and two bits."""

    at: np.ndarray
    entry: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    many: np.ndarray
    block: np.ndarray

    def rows(self) -> tuple[list, list[list[bytes]]]:
        """A row for each bucket: five bytes an entry, the bits on top."""
        low = (self.value & np.uint64(0xFFFFFFFF)).astype("<u4")
        high = (self.value >> np.uint64(32)).astype(np.uint8) | self.many.astype(np.uint8) << 6 | self.block.astype(np.uint8) << 7
        return _packed(self.bucket, low, high)


@dataclass
class Windows:
    """Distinct windows of a chunk: which entry each of those at `at` is, and of each entry its bucket, hash and least key."""

    at: np.ndarray
    entry: np.ndarray
    bucket: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray

    def rows(self) -> tuple[list, list[list[bytes]]]:
        """A row for each bucket: 12 bytes of hash an entry, and the keys from the least one on."""
        base = int(self.least.min(initial=_LAST))
        above = self.least.astype(np.uint64) - np.uint64(base % (1 << 64))
        above = above.astype("<u4" if above.max(initial=0) < 1 << 32 else "<u8")
        buckets, parts = _packed(self.bucket, self.low.astype("<u8"), (self.high >> np.uint64(32)).astype("<u4"), above)
        return buckets, [*parts, [base] * len(buckets)]


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> tuple[list, list[list[bytes]]]:
    first = _firsts(bucket)
    edges = np.append(first, len(bucket)).tolist()
    pieces = [[c[a:b].tobytes() for a, b in zip(edges, edges[1:])] for c in columns]
    return bucket[first].tolist(), pieces


def _answers(buckets: list[dict], size: int, owners: np.ndarray, *names: str) -> list[np.ndarray]:
    """The bits that came back, in the order of the chunk's entries; zero for buckets without an answer."""
    found = [np.zeros(size, bool) for _ in names]
    for answer in buckets or ():
        a, b = np.searchsorted(owners, [answer["bucket"], answer["bucket"] + 1])
        for out, name in zip(found, names):
            out[a:b] = np.unpackbits(np.frombuffer(answer[name], np.uint8), count=b - a)
    return found


def _meet_anchors(group: pa.Table) -> pa.Table:
    """Of one bucket: which hashes recur in another document, and which of these are a block's somewhere."""
    low, high = (_joined(group, name, kind) for name, kind in (("low", "<u4"), ("high", np.uint8)))
    value = low.astype(np.uint64) | (high & 0x3F).astype(np.uint64) << np.uint64(32)
    order = np.argsort(value, kind="stable")
    first = _firsts(value[order])
    sizes = np.diff(np.append(first, len(order)))
    recurs = (sizes > 1) | (np.bitwise_or.reduceat(high[order], first) & 0x40 > 0) if len(first) else np.zeros(0, bool)
    hit = recurs & (np.bitwise_or.reduceat(high[order], first) & 0x80 > 0) if len(first) else recurs
    bits = [_placed(order, np.repeat(flag, sizes)) for flag in (recurs, hit)]
    return _bits(group, np.cumsum([0, *_lengths(group, "high", 1)]), ["recurs", "hit"], bits)


def _meet_windows(group: pa.Table) -> pa.Table:
    """Of one bucket: which windows a document with a smaller key than the chunk's least has in another chunk."""
    low, high = _joined(group, "low", "<u8"), _joined(group, "high", "<u4")
    counts = _lengths(group, "low", 8)
    parts = []
    for row, size in enumerate(counts):
        raw = group.column("keys")[row].as_buffer()
        above = np.frombuffer(raw, "<u4" if len(raw) == 4 * size else "<u8").astype(np.uint64)
        parts.append((above + np.uint64(group.column("base")[row].as_py() % (1 << 64))).astype(np.int64))
    keys = np.concatenate([np.zeros(0, np.int64), *parts])
    order = np.lexsort((keys, high, low))
    first = _firsts(low[order], high[order])
    least = np.repeat(keys[order][first], np.diff(np.append(first, len(order))))
    return _bits(group, np.cumsum([0, *counts]), ["earlier"], [_placed(order, least < keys[order])])


def _joined(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in group.column(name)), kind)


def _lengths(group: pa.Table, name: str, width: int) -> list[int]:
    return [len(v.as_buffer()) // width for v in group.column(name)]


def _placed(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    found = np.empty(len(order), bool)
    found[order] = ordered
    return found


def _bits(group: pa.Table, edges: np.ndarray, names: list[str], flags: list[np.ndarray]) -> pa.Table:
    """Rows of (chunk, bucket, packed bits...), without those in which no bit is set."""
    rows = [(row, a, b) for row, (a, b) in enumerate(zip(edges, edges[1:])) if flags[0][a:b].any()]
    taken = group.select(["chunk", "bucket"]).take(pa.array([r[0] for r in rows], pa.int64()))
    for name, flag in zip(names, flags):
        taken = taken.append_column(name, pa.array([np.packbits(flag[a:b]).tobytes() for _, a, b in rows], pa.binary()))
    return taken


def _chunks(docs: DataFrame, key: str, text: str, chunk_words: int) -> DataFrame:
    """(chunk, keys, data) of all rows; the key's null is kept as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys: list = []
        lines: list[bytes] = []
        total = 0

        def made() -> pa.RecordBatch:
            data = b"".join(lines)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["chunk", "keys", "data"]
            )

        for batch in batches:
            for row in range(batch.num_rows):
                value = batch.column(1)[row]
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                keys.append(batch.column(0)[row].as_py())
                lines.append(b" ".join(words) + b"\n")
                total += len(words)
                if total >= chunk_words or len(keys) >= chunk_words:
                    yield made()
                    keys, lines, total, number = [], [], 0, number + 1
        if keys:
            yield made()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "chunk long, keys array<long>, data binary")


def without_repeats(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", chunk_words: int = CHUNK_WORDS, bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """One row per row of `docs`: key, n_words, removed (start, length of the maximal stretches) and the text that is kept.

    A word goes if it is in a window of `window` words that also starts in a
    document with a smaller key, whatever of that document is removed itself.
    Words are what ASCII white space separates, unchanged; kept ones are joined by
    one space. Keys are whole numbers; null comes after all others. Rows with the
    same key do not affect each other, and each comes out. Null, empty and blank
    texts have no words. Texts shorter than a window lose nothing. Of any length
    they are read whole, at about 100 bytes a word. Other columns are not read; an
    empty table gives an empty result.

    Runs at once up to the last pass, with the chunks and the bits stored in the
    shared folder.
    """
    if window < 1:
        raise ValueError("window must be 1 or more")
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(partitions(spark), blocks(chars, bucket_chars))
    name = f"chunks_{uuid.uuid4().hex}"
    _chunks(docs, key, text, chunk_words).write.bucketBy(partitions(spark), "chunk").option("path", fresh_path(spark, name)).option(
        "compression", "zstd"
    ).saveAsTable(name)
    chunks = spark.table(name)

    def opened(batch: pa.RecordBatch, powers: _Powers) -> Iterator[tuple[pa.Scalar, Chunk, list, pa.RecordBatch]]:
        for row in range(batch.num_rows):
            keys = batch.column("keys")[row].as_py()
            order = np.array([_LAST if k is None else k for k in keys], np.int64)
            yield batch.column("chunk")[row], Chunk(batch.column("data")[row].as_buffer().to_pybytes(), order, window, powers), keys, batch.slice(row, 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for number, chunk, _, _ in opened(batch, powers):
                bucket, (low, high) = chunk.anchors(buckets).rows()
                yield _batch(number, bucket, [low, high], ["low", "high"])

    def found(chunk: Chunk, row: pa.RecordBatch) -> np.ndarray:
        anchors = chunk.anchors(buckets)
        bits = _answers(row.column("anchors")[0].as_py(), len(anchors.bucket), anchors.bucket, "recurs", "hit")
        return chunk.candidates(anchors, *bits)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for number, chunk, _, row in opened(batch, powers):
                bucket, parts = chunk.windows(found(chunk, row), buckets).rows()
                yield _batch(number, bucket, parts, ["low", "high", "keys", "base"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for _, chunk, keys, row in opened(batch, powers):
                seen = chunk.windows(found(chunk, row), buckets)
                earlier = _answers(row.column("windows")[0].as_py(), len(seen.bucket), seen.bucket, "earlier")[0]
                gone = earlier[seen.entry] | (seen.least[seen.entry] < chunk.keys[seen.at])
                covered = chunk.covered(seen.at[gone])
                yield _stripped(chunk, covered, keys)

    sent = chunks.select("chunk", "data", "keys").mapInArrow(send, "chunk long, bucket long, low binary, high binary")
    met = sent.groupBy("bucket").applyInArrow(_meet_anchors, "chunk long, bucket long, recurs binary, hit binary")
    marked = _with(chunks, stored(met, "anchors"), "anchors")
    sent = marked.mapInArrow(extend, "chunk long, bucket long, low binary, high binary, keys binary, base long")
    met = sent.groupBy("bucket").applyInArrow(_meet_windows, "chunk long, bucket long, earlier binary")
    marked = _with(marked, stored(met, "windows"), "windows")
    made = marked.mapInArrow(strip, "key long, n_words long, removed array<struct<start:bigint,length:bigint>>, kept string")
    return made.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_words", "removed", "kept")


def _with(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The chunks with what came back to each; their stored buckets are those of the join."""
    fields = [c for c in answers.columns if c != "chunk"]
    return chunks.join(answers.groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias(name)), "chunk", "left")


def _batch(number: pa.Scalar, bucket: list, parts: list[list], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([number.as_py()] * len(bucket), pa.int64()), pa.array(bucket, pa.int64())]
    columns += [pa.array(p, pa.int64() if n == "base" else pa.binary()) for n, p in zip(names, parts)]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", *names])


def _stripped(chunk: Chunk, covered: np.ndarray, keys: list) -> pa.RecordBatch:
    spans = [chunk.spans(covered, d) for d in range(len(keys))]
    rows = np.concatenate([np.zeros((0, 2), np.int64), *spans])
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["start", "length"])
    kept = pa.array([chunk.kept(s, d) for d, s in enumerate(spans)], pa.string())
    sizes = pa.array(chunk.sizes, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), sizes, pa.ListArray.from_arrays(pa.array(offsets), fields), kept], ["key", "n_words", "removed", "kept"]
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, span: total + span["length"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES = {
    "op11_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) x),
m AS (SELECT gram, MIN(doc_id) AS least FROM g GROUP BY gram),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN m USING (gram), range(0, 13) r(k) WHERE least < doc_id),
k AS (SELECT e.doc_id, COUNT(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) e ANTI JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
}
QUERIES = {"op11_substring_dedup": op11_substring_dedup}
