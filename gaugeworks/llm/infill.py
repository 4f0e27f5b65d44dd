"""Fill-in-the-middle: texts cut in three and written in another order, with the cuts found in a Fenwick tree.

A text is laid out in blocks of a fixed number of bytes. Two Fenwick trees
hold how many units and how many code points start in each block. A cut after
so many units is found by binary lifting: the descent adds up whole subtrees of
blocks while they hold no more units than asked for, and stops at the block
of the cut with the code points before it; only that block is searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.base import table

BLOCK = 1024
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def code_points(data: np.ndarray) -> np.ndarray:
    """Whether a code point starts at each byte of UTF-8."""
    return (data & 0xC0) != 0x80


def words(data: np.ndarray) -> np.ndarray:
    """Whether a word between ASCII white space starts at each byte; white space belongs to the word before it."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    return ~blank & np.concatenate(([True], blank[:-1])) if len(data) else blank


#: What a cut may lie between.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"code point": code_points, "word": words}


class Fenwick:
    """Counts of consecutive blocks; node i sums the last (i & -i) blocks up to block i."""

    def __init__(self, counts: list[int]):
        self.size = len(counts)
        self.tree = [0, *counts]
        for i in range(1, self.size + 1):
            above = i + (i & -i)
            if above <= self.size:
                self.tree[above] += self.tree[i]

    def before(self, block: int) -> int:
        """Sum of the blocks before `block`."""
        total = 0
        while block:
            total += self.tree[block]
            block &= block - 1
        return total

    def descend(self, count: int) -> tuple[int, int]:
        """The number of whole blocks that hold no more than `count` together, as many as can be, and what is left of it."""
        at, step = 0, 1 << self.size.bit_length() >> 1
        while step:
            if at + step <= self.size and self.tree[at + step] <= count:
                at += step
                count -= self.tree[at]
            step >>= 1
        return at, count


class Layout:
    """The blocks of one text."""

    def __init__(self, data: np.ndarray, unit: str = "code point", block: int = BLOCK):
        self.block, self.length = block, len(data)
        self.starts, self.points = UNITS[unit](data), code_points(data)
        edges = np.arange(0, len(data), block)
        count = lambda mask: np.add.reduceat(mask, edges, dtype=np.int64).tolist() if len(data) else []
        self.unit_tree, self.point_tree = Fenwick(count(self.starts)), Fenwick(count(self.points))
        self.units = int(np.count_nonzero(self.starts))

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code points before unit number `units`, counted from 0; of the text's end if there is none.

        What stands before the first unit goes with it.
        """
        if units <= 0:
            return 0, 0
        block, left = self.unit_tree.descend(units)
        points, low = self.point_tree.before(block), block * self.block
        if block == self.unit_tree.size:
            return self.length, points
        at = low + int(np.flatnonzero(self.starts[low : low + self.block])[left])
        return at, points + int(np.count_nonzero(self.points[low:at]))


def transform(
    docs: DataFrame, unit: str = "code point", block: int = BLOCK, seed: int = SEED, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of `docs`: key, n (units), form, prefix_chars, middle_chars and output.

    Cuts and form follow from the SHA-256 of `seed:key` alone, so repeated rows
    get the same and a run can be repeated. A text that is empty or null or holds
    a marker is plain, and so are `plain` percent of the rest; of the others `spm`
    percent have the suffix first (spm), the rest the prefix (psm). Plain rows have
    the text as output and null counts of code points; n counts them as well. Equal
    cuts give an empty middle. A null key counts as the empty text. Texts of any
    length are read whole. Other columns are not read; an empty table gives an
    empty result.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, forms, firsts, seconds = batch.columns
            n, prefix, middle, output = [], [], [], []
            for value, form, first, second in zip(values, forms.to_pylist(), firsts.to_pylist(), seconds.to_pylist()):
                raw = value.as_buffer() if value.is_valid else pa.py_buffer(b"")
                laid = Layout(np.frombuffer(raw, np.uint8), unit, block)
                n.append(laid.units)
                if form == "plain":
                    prefix.append(None)
                    middle.append(None)
                    output.append(raw.to_pybytes())
                    continue
                low, high = sorted((first % (laid.units + 1), second % (laid.units + 1)))
                (a, before), (b, until) = laid.cut(low), laid.cut(high)
                prefix.append(before)
                middle.append(until - before)
                output.append(_written(form, raw.to_pybytes(), a, b))
            found = [pa.array(c, pa.int64()) for c in (n, prefix, middle)]
            yield pa.RecordBatch.from_arrays(
                [keys, forms, *found, pa.array(output, pa.string())], ["key", "form", "n", "prefix", "middle", "output"]
            )

    kind = docs.schema[key].dataType.simpleString()
    value = F.col(text).cast("string")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    marked = F.contains(value, F.lit(PREFIX)) | F.contains(value, F.lit(SUFFIX)) | F.contains(value, F.lit(MIDDLE))
    whole = F.coalesce(value == "", F.lit(True)) | marked | (number(2) % 100 >= 100 - plain)
    form = F.when(whole, "plain").when(number(3) % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(
        F.col(key).alias("key"), value.alias("text"), form.alias("form"), number(0).alias("first"), number(1).alias("second")
    )
    made = rows.mapInArrow(run, f"key {kind}, form string, n long, prefix long, middle long, output string")
    return made.select(
        F.col("key").alias(key), "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"), "output"
    )


def _written(form: str, data: bytes, a: int, b: int) -> bytes:
    p, s, m = (marker.encode() for marker in (PREFIX, SUFFIX, MIDDLE))
    if form == "spm":
        return b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def restored(form: Column, output: Column) -> Column:
    """The text again. No marker is in a text that is cut, and none overlaps another, so each is found where it was put."""
    middle = F.substring_index(output, MIDDLE, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(F.substring_index(output, second, 1), first, -1)
        return head, F.substring_index(F.substring_index(output, second, -1), MIDDLE, 1)

    prefix, suffix = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(late_prefix, middle, late_suffix))
        .otherwise(output)
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


ORACLES = {
    "op13_fill_in_middle": """
WITH t AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
}
QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
