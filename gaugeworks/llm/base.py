"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.workspace import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder all executors share and read back: work before it runs once and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"llm_{name}"
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks(rows: int, most: int) -> int:
    """How many blocks of at most about `most` rows hold `rows` rows."""
    return max(1, math.ceil(rows / most))


def portions(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices of so many rows, for steps that give whole texts back: what they return stays small on both sides."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batches: Iterator, *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row, without turning a whole batch into Python objects."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
        for row in range(batch.num_rows):
            yield tuple(column[row].as_py() for column in columns)


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut at white space, so that long ones need no more memory."""
    start = 0
    while start < len(text):
        found = _BLANK.search(text, start + size)
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


_BLANK = re.compile(r"[ \t\n\r]")


def byte_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def run_hashes(pieces: Iterator[list[bytes]], width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of `width` words joined by a space, repeats included, piece by piece of a text's words.

    Of fewer words than that there is one run, of all of them; without words none.
    """
    words: list[bytes] = []
    some = False
    for piece in pieces:
        words += piece
        if len(words) >= width:
            some = True
            yield _hashes(words, width, seed)
            words = words[len(words) - width + 1 :]
    if words and not some:
        yield _hashes(words, len(words), seed)


def _hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def spans_text(spans: Column) -> Column:
    """An array of (kind, start, end, ...) as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
