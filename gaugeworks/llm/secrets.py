"""Secret scan with links between the parts of multipart credentials.

Patterns find what is a secret by itself. What is only a candidate - an
account identifier, an endpoint, a string of high entropy - is reported only
where parts that complete each other stand in one scope: each identifier opens
an interval around itself that ends at the paragraph's borders, and candidates
are joined to the intervals that hold them by position: a search in the sorted
starts finds how many parts begin before an interval ends, and the greatest end
among these, kept per paragraph, tells whether one reaches into it. A document
of any number of parts costs no more than sorting them, and no pairs are made.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gaugeworks.llm.base import fresh, portions, spans_text, table, texts

# The patterns of the three kinds that are always reported, and their least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

# Parts of credentials.
IDENTIFIER = re.compile(
    r"""(?ai:\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id|tenant_?id)\b)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})"""
)
TEMPORARY = re.compile(r"A(?:SIA|ROA|IDA)(?<![A-Za-z0-9]....)[A-Z0-9]{12,}")
ENDPOINT = re.compile(
    r"""(?ai:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s"'<>]+|\b(?:host(?:name)?|endpoint|server|bucket)["']?\x20*[:=]\x20*["']?[a-z0-9.:/_-]{3,})"""
)
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PARAGRAPH = re.compile(r"\n\s*\n")

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
RADIUS = 400
LEAST_BITS = 3.5
SCHEMA = "array<struct<kind:string,start:int,end:int>>"
Span = tuple[str, int, int]


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[Span]:
    found = []
    if ":" in text or "=" in text:
        found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def linked_spans(text: str, base: list[Span], radius: int = RADIUS) -> list[Span]:
    """Weak parts that complete each other, in order of position.

    A secret counts with an identifier in scope, an identifier with a secret, and
    an endpoint with both. The base spans take part: an access key is an
    identifier, an assignment or a hex string is a secret.
    """
    weak_ids = [(m.start(), m.end()) for m in TEMPORARY.finditer(text)]
    if ":" in text or "=" in text:
        weak_ids += [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    identifiers = sorted(weak_ids + [(a, b) for k, a, b in base if k == "access"])
    if not identifiers:
        return []
    borders = [m.start() for m in PARAGRAPH.finditer(text)]
    taken, named = _Parts([(a, b) for _, a, b in base], [], radius), _Parts(identifiers, [], radius)
    weak_secrets = [
        (m.start(), m.end())
        for m in OPAQUE.finditer(text)
        if not taken.overlap(m.start(), m.end())
        and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= LEAST_BITS
        and not named.overlap(m.start(), m.end())
    ]
    secrets = sorted(weak_secrets + [(a, b) for k, a, b in base if k != "access"])
    if not secrets:
        return []
    ids, keys = _Parts(identifiers, borders, radius), _Parts(secrets, borders, radius)
    found = [("identifier", a, b) for a, b in weak_ids if keys.near(a, b) and not taken.overlap(a, b)]
    found += [("secret", a, b) for a, b in weak_secrets if ids.near(a, b)]
    found += [
        ("endpoint", m.start(), m.end())
        for m in ENDPOINT.finditer(text)
        if ids.near(m.start(), m.end()) and keys.near(m.start(), m.end())
    ]
    return found


class _Parts:
    """Distinct parts by start, asked whether one overlaps a span, or lies within a radius of it in its paragraph.

    `tops` holds for each part the two greatest ends, with their parts, among those of its paragraph up to it.
    """

    def __init__(self, parts: list[tuple[int, int]], borders: list[int], radius: int):
        self.parts, self.borders, self.radius = sorted(set(parts)), borders, radius
        self.starts = [a for a, _ in self.parts]
        self.paragraphs = [bisect_left(borders, a) for a in self.starts]
        self.tops: list[list[tuple[int, tuple[int, int]]]] = []
        before: list[tuple[int, tuple[int, int]]] = []
        for k, part in enumerate(self.parts):
            if k and self.paragraphs[k] != self.paragraphs[k - 1]:
                before = []
            before = sorted([*before, (part[1], part)], reverse=True)[:2]
            self.tops.append(before)

    def overlap(self, start: int, end: int) -> bool:
        """Only for parts without borders, which are one paragraph."""
        k = bisect_left(self.starts, end)
        return k > 0 and self.tops[k - 1][0][0] > start

    def near(self, start: int, end: int) -> bool:
        here = bisect_left(self.borders, start)
        last = end + self.radius
        if here < len(self.borders):
            last = min(last, self.borders[here])
        k = bisect_right(self.starts, last)
        if not k or self.paragraphs[k - 1] != here:
            return False
        return any(b >= start - self.radius for b, part in self.tops[k - 1] if part != (start, end))


def find(text: str | None, radius: int = RADIUS) -> list[Span]:
    """All spans of a text by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    base = base_spans(text)
    found = base + linked_spans(text, base, radius)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Key and spans (kind, start, end) of each row of `docs`, by start.

    Null and empty texts have no spans. Repeated rows come out as often as they
    went in; a null key stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, radius)] for (t,) in texts([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, spans {SCHEMA}").select(F.col("key").alias(key), "spans")


def redacted(text: str, radius: int = RADIUS) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in find(text, radius):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", radius: int = RADIUS) -> DataFrame:
    """All rows and columns of `docs`, with the secrets in the text replaced.

    Where the text changed, `length`, if it is a column, becomes its new length.
    """
    changed = fresh(docs, "changed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            at = batch.schema.get_field_index(text)
            old = [t for (t,) in texts([batch], text)]
            new = [None if t is None else redacted(t, radius) for t in old]
            columns = [*batch.columns, pa.array([a != b for a, b in zip(old, new)], pa.bool_())]
            columns[at] = pa.array(new, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, changed])

    made = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(changed, BooleanType())]))

    def column(name: str) -> Column:
        if name == length:
            kind = docs.schema[name].dataType
            return F.when(F.col(changed), F.char_length(text).cast(kind)).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return made.select(*[column(name) for name in docs.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def only(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(only(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(spans_text(only(*KINDS[:3])), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


QUERIES = {"op4_secret_scan": op4_secret_scan}
