"""Exact order statistics without sorting the table in one task or shuffling it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType, TimestampNTZType, TimestampType

from gaugeworks.functions.columns import name_of

# Relative rank error 1e-4; a sketch of this size is cheap to merge from many tasks.
SKETCH_ACCURACY = 10_000
# Half of a bracket around a rank, as a share of the rows: twice what the sketch can be wrong.
REACH = 2 / SKETCH_ACCURACY
# Rows that may lie in a bracket whose values are counted; a fuller one is narrowed in another pass.
MOST = 5_000_000
# Steps by which a bracket is narrowed.
GRID = 200
FENCE_FACTOR = 1.5
_INF = math.inf


def sketched_quantiles(columns: Sequence[str], shares: Sequence[float], prefix: str = "q") -> list[Column]:
    """Aggregates ``<prefix>0, <prefix>1, ...`` with the approximate quantiles of each column as an array.

    NaN is above every number: the sketch takes it in as infinity, and a rank among
    the NaN gives NaN again.
    """
    listed = ", ".join(f"{float(s)}D" for s in shares)
    found = []
    for i, c in enumerate(columns):
        v = f"double({name_of(c)})"
        sketch = f"percentile_approx(if(isnan({v}), double('Infinity'), {v}), array({listed}), {SKETCH_ACCURACY})"
        last = f"count({v}) - count_if(isnan({v}))"
        items = [f"if(greatest(ceil({float(s)}D * count({v})), 1) > {last}, double('NaN'), {sketch}[{k}])" for k, s in enumerate(shares)]
        found.append(F.expr(f"if(count({v}) = 0, NULL, array({', '.join(items)})) AS {prefix}{i}"))
    return found


def fences(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    """The bounds beyond which a value is an outlier."""
    if q1 is None or q3 is None:
        return None, None
    reach = FENCE_FACTOR * (q3 - q1)
    return q1 - reach, q3 + reach


def number_sql(column: str, kind: DataType) -> str:
    """A double that grows with the column's value, as SQL text; values that are too near may share one."""
    c = name_of(column)
    if isinstance(kind, DateType):
        return f"double(unix_date({c}))"
    if isinstance(kind, TimestampType):
        return f"double(unix_micros({c}))"
    if isinstance(kind, TimestampNTZType):
        return f"double(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c}))"
    return f"double({c})"


_OWN_TYPES = (ByteType, ShortType, IntegerType, LongType, DecimalType, DateType, TimestampType, TimestampNTZType)


@dataclass
class _Search:
    """Where the wanted ranks of one column lie."""

    ranks: list[int]
    total: int
    numbers: int
    quartiles: tuple[int, int] | None = None
    width: int = 1
    brackets: dict[int, tuple[float, float]] = field(default_factory=dict)
    inside: dict[int, float] = field(default_factory=dict)

    def wanted(self) -> list[int]:
        """The ranks that are numbers, and not NaN."""
        return sorted({r for r in self.ranks if r <= self.numbers})

    def fenced(self) -> bool:
        return self.quartiles is not None and all(self.ranks[k] <= self.numbers for k in self.quartiles)

    def fence_brackets(self) -> list[tuple[float, float]]:
        """Where the two fences can lie, given where the quartiles can."""
        (a, b), (c, d) = (self.brackets[self.ranks[k]] for k in self.quartiles)
        found = []
        for low, high in ((fences(a, d)[0], fences(b, c)[0]), (fences(b, c)[1], fences(a, d)[1])):
            low, high = (-_INF if math.isnan(low) else low), (_INF if math.isnan(high) else high)
            found.append((min(low, high), max(low, high)))
        return found

    def intervals(self) -> list[tuple[float, float]]:
        """The brackets of all ranks and fences in order, overlapping ones merged."""
        found: list[tuple[float, float]] = []
        every = list(self.brackets.values()) + (self.fence_brackets() if self.fenced() else [])
        for low, high in sorted(every):
            if found and low <= found[-1][1]:
                found[-1] = (found[-1][0], max(high, found[-1][1]))
            else:
                found.append((low, high))
        return found


def _text(number: float) -> str:
    return f"double('{number}')" if math.isinf(number) or math.isnan(number) else f"{number!r}D"


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    extra: Sequence[Column] = (),
    quartiles: tuple[int, int] | None = None,
) -> tuple[DataFrame, Row]:
    """(column, quantiles, texts, outside): the smallest value whose rank reaches ``share * n``; NULLs are left out, NaN comes last.

    Runs at once, in two passes over the table. The first sketches the numbers,
    which gives a bracket of values around each rank that is wider than the sketch
    can be wrong, and the ``extra`` aggregates, which are returned next to the
    result. The second counts rows inside the brackets per value, in the column's
    own type, and all others per gap between brackets: a thousandth of the rows or
    so is shuffled. Of so many rows that this is still too much the brackets are
    narrowed in further passes first. If a rank is in none of its brackets after
    all, they are widened and the rows counted again.

    ``quantiles`` are doubles; ``texts`` hold the same values as they print in the
    type of the column, so that no digit of a bigint, decimal or timestamp is lost.
    ``quartiles`` tells which two shares are the quartiles; the rows beyond the
    fences they give are then counted in the same pass, as ``outside``. A column
    without values has NULL quantiles and nothing outside.
    """
    spark = df.sparkSession
    columns, shares = list(columns), [float(s) for s in shares]
    kinds = [df.schema[c].dataType for c in columns]
    numbers = [number_sql(c, kind) for c, kind in zip(columns, kinds)]
    own = [name_of(c) if isinstance(kind, _OWN_TYPES) else f"double({name_of(c)})" for c, kind in zip(columns, kinds)]
    typed = df.select(*[F.expr(f"{v} AS v{i}") for i, v in enumerate(numbers)], *[F.expr(f"{o} AS o{i}") for i, o in enumerate(own)])

    def points(width: int) -> list[float]:
        return [min(max(s + side * width * REACH, 0.0), 1.0) for s in shares for side in (-1, 1)]

    def sketches(names: Sequence[str], which: Sequence[int], width: int) -> list[Column]:
        listed = ", ".join(f"{p!r}D" for p in points(width))
        return [
            F.expr(f"percentile_approx(if(isnan({v}), double('Infinity'), {v}), array({listed}), {SKETCH_ACCURACY}) AS __p{i}")
            for i, v in zip(which, names)
        ]

    def bracketed(search: _Search, found: Sequence[float]) -> None:
        search.brackets.clear()
        for k, (s, rank) in enumerate(zip(shares, search.ranks)):
            if rank <= search.numbers:
                reach = search.width * REACH
                low = found[2 * k] if s - reach > 0 else -_INF
                high = found[2 * k + 1] if s + reach < 1 else _INF
                before = search.brackets.get(rank, (low, high))
                search.brackets[rank] = (min(low, before[0]), max(high, before[1]))
                search.inside[rank] = 2 * reach * search.total

    every = range(len(columns))
    first = df.agg(
        *extra,
        *[F.expr(f"count({v}) AS __n{i}") for i, v in enumerate(numbers)],
        *[F.expr(f"count_if(isnan({v})) AS __nan{i}") for i, v in enumerate(numbers)],
        *sketches(numbers, every, 1),
    ).first()
    searches: dict[int, _Search] = {}
    for i in every:
        n, nan = first[f"__n{i}"], first[f"__nan{i}"]
        if n:
            searches[i] = _Search([max(math.ceil(s * n), 1) for s in shares], n, n - nan, quartiles)
            bracketed(searches[i], first[f"__p{i}"])
    values: dict[tuple[int, int], tuple[float, str]] = {}
    outside: dict[int, int] = {i: s.numbers for i, s in searches.items() if quartiles and not s.fenced()}
    open_ = {i: s for i, s in searches.items() if s.brackets}
    while open_:
        _narrow(typed, open_)
        found, beyond, missed = _counted(typed, open_, kinds)
        values.update(found)
        outside.update(beyond)
        open_ = {i: s for i, s in open_.items() if i in missed}
        for s in open_.values():
            s.width *= 16
        for width in {s.width for s in open_.values()}:
            which = [i for i, s in open_.items() if s.width == width]
            again = typed.agg(*sketches([f"v{i}" for i in which], which, width)).first()
            for i in which:
                bracketed(open_[i], again[f"__p{i}"])
    result = []
    for i, c in enumerate(columns):
        search = searches.get(i)
        if search is None:
            result.append((c, [None] * len(shares), [None] * len(shares), 0 if quartiles else None))
            continue
        pairs = [values[i, r] if r <= search.numbers else (math.nan, "NaN") for r in search.ranks]
        result.append((c, [v for v, _ in pairs], [t for _, t in pairs], outside.get(i)))
    schema = "column string, quantiles array<double>, texts array<string>, outside bigint"
    return spark.createDataFrame(result, schema), first


def _narrow(typed: DataFrame, searches: dict[int, _Search]) -> None:
    """Cut brackets that hold too many rows to a few of the steps of a sketch of what is in them."""
    steps = ", ".join(f"{k / GRID!r}D" for k in range(GRID + 1))
    while True:
        full = [
            (i, rank)
            for i, s in searches.items()
            for rank, (low, high) in s.brackets.items()
            if s.inside[rank] > MOST and low < high
        ]
        if not full:
            return
        aggregates = []
        for k, (i, rank) in enumerate(full):
            low, high = (_text(x) for x in searches[i].brackets[rank])
            held = f"v{i} >= {low} AND v{i} <= {high}"
            aggregates += [
                F.expr(f"count_if(v{i} < {low}) AS below{k}"),
                F.expr(f"count_if({held}) AS held{k}"),
                F.expr(f"percentile_approx(if({held}, v{i}, NULL), array({steps}), {SKETCH_ACCURACY}) AS grid{k}"),
            ]
        row = typed.agg(*aggregates).first()
        for k, (i, rank) in enumerate(full):
            search, place, held = searches[i], rank - row[f"below{k}"], row[f"held{k}"]
            search.inside[rank] = 0.0
            if not 0 < place <= held:
                continue  # not in its bracket: counting finds out
            at = place / held * GRID
            low, high = math.floor(at) - 1, math.ceil(at) + 1
            before = search.brackets[rank]
            now = (before[0] if low <= 0 else row[f"grid{k}"][low], before[1] if high >= GRID else row[f"grid{k}"][high])
            search.brackets[rank] = now
            if now != before:
                search.inside[rank] = held * (high - low) / GRID


def _counted(
    typed: DataFrame, searches: dict[int, _Search], kinds: Sequence[DataType]
) -> tuple[dict[tuple[int, int], tuple[float, str]], dict[int, int], set[int]]:
    """Value and text at the wanted ranks by (column, rank), rows beyond the fences, and the columns with a rank outside all intervals."""
    own = {i: kinds[i].simpleString() if isinstance(kinds[i], _OWN_TYPES) else "double" for i in searches}
    fields = {kind: f"f{k}" for k, kind in enumerate(sorted(set(own.values())))}
    structs = []
    for i, search in searches.items():
        intervals = search.intervals()
        part = "CASE " + " ".join(f"WHEN v{i} <= {_text(high)} THEN {k}" for k, (_, high) in enumerate(intervals))
        part = f"CASE WHEN v{i} IS NOT NULL THEN {part} ELSE {len(intervals)} END END"
        held = " OR ".join(f"(v{i} >= {_text(low)} AND v{i} <= {_text(high)})" for low, high in intervals)
        held = f"({held}) AND NOT isnan(v{i})"
        typed_fields = [
            f"'{name}', CAST({f'if({held}, o{i}, NULL)' if kind == own[i] else 'NULL'} AS {kind})" for kind, name in fields.items()
        ]
        structs.append(f"named_struct('i', {i}, 'part', {part}, 'number', if({held}, v{i}, NULL), {', '.join(typed_fields)})")
    names = list(fields.values())
    counted = (
        typed.select(F.expr(f"inline(array({', '.join(structs)}))"))
        .where("part IS NOT NULL")
        .groupBy("i", "part", "number", *names)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Per column no more rows than the brackets may hold, and the gaps.
    order = ["part", F.asc_nulls_first("number"), *[F.asc_nulls_first(f) for f in names]]
    reached = counted.withColumn("reached", F.sum("n").over(Window.partitionBy("i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))

    def of_column(pick) -> str:
        return "CASE i " + " ".join(f"WHEN {i} THEN {pick(s)}" for i, s in searches.items()) + " END"

    whole = Window.partitionBy("i")
    size = len(next(iter(searches.values())).ranks)
    text = "coalesce(" + ", ".join(f"string({f})" for f in names) + ")"
    hits = [of_column(lambda s, k=k: f"reached - n < {s.ranks[k]} AND {s.ranks[k]} <= reached") for k in range(size)]
    marked = reached.select(
        "*",
        *[F.max(F.expr(f"if({hit}, struct(number, {text} AS text), NULL)")).over(whole).alias(f"q{k}") for k, hit in enumerate(hits)],
    )
    quartiles = next(iter(searches.values())).quartiles
    beyond = "NULL"
    if quartiles:
        q1, q3 = (f"q{k}.number" for k in quartiles)
        low, high = (f"({a} {sign} {FENCE_FACTOR}D * ({q3} - {q1}))" for a, sign in ((q1, "-"), (q3, "+")))

        def gaps(search: _Search) -> str:
            """Gaps up to the lower fence's interval are below it, those above the upper one's beyond it."""
            if not search.fenced():
                return "false"
            intervals = search.intervals()
            first, last = (
                next((k for k, (a, b) in enumerate(intervals) if a <= x <= b), side)
                for (x, _), side in zip(search.fence_brackets(), (0, len(intervals)))
            )
            return f"part <= {first} OR part > {last}"

        beyond = f"sum(if(if(number IS NULL, {of_column(gaps)}, number < {low} OR number > {high}), n, 0))"
    per = marked.groupBy("i").agg(*[F.first(f"q{k}").alias(f"q{k}") for k in range(size)], F.expr(f"{beyond} AS beyond"))
    found: dict[tuple[int, int], tuple[float, str]] = {}
    outside: dict[int, int] = {}
    missed: set[int] = set()
    for row in per.collect():
        search = searches[row["i"]]
        for k, rank in enumerate(search.ranks):
            if rank <= search.numbers:
                hit = row[f"q{k}"]
                if hit is None or hit["number"] is None:
                    missed.add(row["i"])
                else:
                    found[row["i"], rank] = (hit["number"], hit["text"])
        if search.fenced():
            outside[row["i"]] = row["beyond"]
    missed |= set(searches) - {row for row, _ in found}
    return found, {i: n for i, n in outside.items() if i not in missed}, missed


def beaten_pairs(per_value: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: ``won`` (pairs of a ``pos`` row above a ``neg`` row, ties half), ``pos_total``, ``neg_total``.

    ``per_value`` has one row per group and value with the counts ``pos`` and
    ``neg``. The values are cut into ranges, as for a global sort. Pairs within a
    range come from a window over that range alone, pairs across ranges from the
    totals of the ranges. There is a single chain of stages, so every row has one
    range however often a task is run.
    """
    by = list(by)
    ranged = per_value.repartitionByRange(*by, value).withColumn("__range", F.spark_partition_id())
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ordered = ranged.withColumn("__below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    per_range = ordered.groupBy(*by, "__range").agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.expr("sum(double(pos) * (double(__below) + double(neg) / 2)) AS won"),
    )
    # One row per range and group, no more than there are shuffle partitions.
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_range.withColumn("__below", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    return offset.groupBy(*by).agg(
        F.expr("sum(won + double(pos) * double(__below)) AS won"),
        F.sum("pos").alias("pos_total"),
        F.sum("neg").alias("neg_total"),
    )
