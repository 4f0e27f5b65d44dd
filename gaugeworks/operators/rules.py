"""Data-quality rules as aggregate expressions.

A rule says which aggregates it needs, how the observed value follows from them
and when it passes, all as Spark SQL expressions. It never runs anything: a suite
puts the aggregates of all rules into one pass. Adding a rule means returning
another :class:`Rule`.
"""

from __future__ import annotations

import datetime as dt
import itertools
import json
import math
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.functions.columns import name_of, share_sql, text_literal

INFO, WARNING, ERROR, CRITICAL = "info", "warning", "error", "critical"
BLOCKING = (ERROR, CRITICAL)

ROWS = "n_rows"
_SHARE_DIGITS = 4
_SCALARS = itertools.count()


@dataclass(frozen=True)
class Counted:
    """What a rule takes from the rows counted per key.

    ``aggregates`` are SQL over one row per distinct key with its row count ``n`` and,
    for a rule with a table ``known`` of one column, the flag ``{known}``, NULL where
    the key isn't listed. Rules with equal ``keys`` can share the count.
    """

    keys: tuple[str, ...]
    aggregates: Mapping[str, str]
    known: DataFrame | None = None


@dataclass(frozen=True)
class Rule:
    """One check.

    ``aggregates`` are computed over the checked table and may be used by name in
    ``observed``, ``passed``, ``severity_sql`` and the texts, next to ``n_rows``.
    ``scalars`` are single values from elsewhere, usable in the same way.
    ``frame`` replaces the pass over the table for rules that need a shuffle: it
    maps the table to one row holding ``n_rows`` and whatever the rule needs, or with
    columns to group by to such a row per group; rules with the same ``frame_key``
    share that row. ``counted`` says the same in a form that rules on equal keys can
    share. ``gate`` looks at the schema; when it fails no other rule of the suite is run.
    """

    name: str
    description: str
    severity: str
    expected: str
    observed: str
    passed: str
    column: str | None = None
    columns: tuple[str, ...] = ()
    aggregates: Mapping[str, str] = field(default_factory=dict)
    scalars: Mapping[str, Column] = field(default_factory=dict)
    frame: Callable[..., DataFrame] | None = None
    frame_key: str | None = None
    counted: Counted | None = None
    observed_text: str | None = None
    severity_sql: str | None = None
    expected_sql: str | None = None
    gate: Callable[[StructType], bool] | None = None


def _listed(names: Sequence[str]) -> str:
    return "[" + ", ".join(names) + "]"


def _literal(value) -> str:
    """A Python value as SQL text of its own type."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return text_literal(value)
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    return str(value)


def _column_list_rule(name, description, severity, offending, expected, gate=None) -> Rule:
    return Rule(
        name=name,
        description=description,
        severity=severity,
        expected=expected,
        observed=str(len(offending)),
        observed_text=text_literal(_listed(offending)),
        passed=str(not offending),
        gate=gate,
    )


def required_columns(schema: StructType, required: Sequence[str]) -> Rule:
    """All names must be in the schema. A suite runs nothing else when this fails."""
    missing = [c for c in required if c not in schema.names]
    return _column_list_rule(
        "required_columns",
        "every required column is present",
        CRITICAL,
        missing,
        _listed(required),
        gate=lambda s: all(c in s.names for c in required),
    )


def extra_columns(schema: StructType, allowed: Sequence[str]) -> Rule:
    """No name beyond the allowed ones."""
    extra = [c for c in schema.names if c not in allowed]
    return _column_list_rule("extra_columns", "no column beyond the allowed ones", WARNING, extra, "[]")


def row_count(min_rows: int, max_rows: int) -> Rule:
    return Rule(
        name="row_count",
        description="number of rows within bounds",
        severity=CRITICAL,
        expected=f"[{min_rows}, {max_rows}]",
        observed=ROWS,
        passed=f"{ROWS} BETWEEN {min_rows} AND {max_rows}",
    )


def volume_change(previous: int | Column | None, max_change: float) -> Rule:
    """Relative change of the row count; informational without a previous count."""
    before, scalars = "bigint(NULL)", {}
    if isinstance(previous, Column):
        before = f"previous_rows_{next(_SCALARS)}"
        scalars = {before: previous.cast("bigint")}
    elif previous is not None:
        before = f"bigint({previous})"
    change = f"try_divide(double(abs({ROWS} - {before})), double({before}))"
    no_baseline = f"({before} IS NULL OR {before} = 0)"
    return Rule(
        name="volume_change",
        description="row count compared with the previous run",
        severity=WARNING,
        severity_sql=f"if({no_baseline}, '{INFO}', '{WARNING}')",
        expected=f"<= {max_change}",
        expected_sql=f"if({no_baseline}, 'no previous run', '<= {max_change}')",
        scalars=scalars,
        observed=f"if({no_baseline}, double({ROWS}), round({change}, {_SHARE_DIGITS}))",
        observed_text=f"if({no_baseline}, string({ROWS}), string(round({change}, {_SHARE_DIGITS})))",
        passed=f"{no_baseline} OR {change} <= {max_change}D",
    )


def _share_rule(name, description, severity, expected, part: str, passed: str, **rest) -> Rule:
    """``passed`` is a condition on ``{}``, which stands for the unrounded share."""
    value = share_sql(part, ROWS)
    return Rule(
        name=name,
        description=description,
        severity=severity,
        expected=expected,
        observed=f"round({value}, {_SHARE_DIGITS})",
        observed_text=f"string(round({value}, {_SHARE_DIGITS}))",
        passed=passed.format(value),
        **rest,
    )


def null_percentage(column: str, max_share: float) -> Rule:
    alias = f"nulls of {column}"
    return _share_rule(
        f"null_percentage[{column}]",
        f"share of NULL in {column}",
        ERROR,
        f"<= {max_share}",
        name_of(alias),
        f"{{}} <= {max_share}D",
        column=column,
        columns=(column,),
        aggregates={alias: f"count_if({name_of(column)} IS NULL)"},
    )


def grouped(df: DataFrame, by: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """The table with the columns to group by, and their names."""
    with_by = df.select("*", *by) if by else df
    return with_by, with_by.columns[len(df.columns) :]


def distinct_keys(df: DataFrame, keys: Sequence[str], by: Sequence[Column] = ()) -> DataFrame:
    """Rows and distinct keys, NULL being one key value, of the table or of each group of ``by``.

    Equal keys are counted before the shuffle, so a frequent key is one row per task.
    """
    df, names = grouped(df, by)
    counted = df.groupBy(*names, *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*names).agg(F.expr(f"coalesce(sum(n), 0) AS {ROWS}"), F.expr("count(1) AS n_keys"))


_KEYS = {"n_keys": "count(1)"}


def counted_keys(df: DataFrame, rules: Sequence[Rule], by: Sequence[Column] = ()) -> DataFrame:
    """The row that rules on equal keys need, of the table or of each group of ``by``, from one count per key."""
    df, names = grouped(df, by)
    keys = {f"__key{k}": F.col(c) for k, c in enumerate(rules[0].counted.keys)}
    rows = df.groupBy(*names, *[c.alias(name) for name, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"))
    wanted, joined = {ROWS: "coalesce(sum(n), 0)"}, set()
    for rule in rules:
        flag = f"__known{len(joined)}"
        if rule.counted.known is not None and rule.frame_key not in joined:
            joined.add(rule.frame_key)
            listed = rule.counted.known.toDF("__key0").distinct().withColumn(flag, F.lit(True))
            rows = rows.join(listed, "__key0", "left")
        for name, sql in rule.counted.aggregates.items():
            wanted.setdefault(name, sql.replace("{known}", flag))
    return rows.groupBy(*names).agg(*[F.expr(f"{sql} AS {name_of(name)}") for name, sql in wanted.items()])


def duplicates(keys: Sequence[str], max_share: float) -> Rule:
    keys = tuple(keys)
    return _share_rule(
        f"duplicates[{','.join(keys)}]",
        f"share of rows beyond the first per {','.join(keys)}",
        ERROR,
        f"<= {max_share}",
        f"{ROWS} - n_keys",
        f"{{}} <= {max_share}D",
        columns=keys,
        frame=lambda df, by=(): distinct_keys(df, keys, by),
        frame_key=json.dumps(keys),
        counted=Counted(keys, _KEYS),
    )


def cardinality(column: str, max_distinct: int, approximate: bool = False) -> Rule:
    """Number of distinct values, NULL included; the approximate count needs no shuffle of its own."""
    common = {
        "name": f"cardinality[{column}]",
        "description": f"distinct values of {column}",
        "severity": WARNING,
        "expected": f"<= {max_distinct}",
        "column": column,
        "columns": (column,),
    }
    if approximate:
        alias, c = f"distinct {column}", name_of(column)
        return Rule(
            **common,
            aggregates={alias: f"approx_count_distinct({c}) + if(count_if({c} IS NULL) > 0, 1, 0)"},
            observed=name_of(alias),
            passed=f"{name_of(alias)} <= {max_distinct}",
        )
    return Rule(
        **common,
        frame=lambda df, by=(): distinct_keys(df, [column], by),
        frame_key=json.dumps([column]),
        counted=Counted((column,), _KEYS),
        observed="n_keys",
        passed=f"n_keys <= {max_distinct}",
    )


def _none_allowed(name: str, description: str, column: str, bad: str, **rest) -> Rule:
    return Rule(
        name=name,
        description=description,
        severity=ERROR,
        expected="0",
        column=column,
        columns=(column,),
        observed=bad,
        passed=f"{bad} = 0",
        **rest,
    )


def value_range(column: str, low, high) -> Rule:
    """No value outside the bounds, numbers, dates or times; NULL passes, NaN does not, a bound of None is none."""
    c = name_of(column)
    outside = [f"{c} {sign} {_literal(bound)}" for sign, bound in (("<", low), (">", high)) if bound is not None]
    alias = f"count_if({' OR '.join(outside) or 'false'})"
    return _none_allowed(
        f"value_range[{column}]",
        f"{column} between {low} and {high}",
        column,
        name_of(alias),
        aggregates={alias: alias},
    )


def allowed_domain(column: str, values: Sequence) -> Rule:
    """No non-NULL value outside a short list."""
    c = name_of(column)
    listed = ", ".join(_literal(v) for v in values if v is not None) or "NULL"
    alias = f"count_if({c} IS NOT NULL AND NOT coalesce({c} IN ({listed}), false))"
    return _none_allowed(
        f"allowed_domain[{column}]",
        f"{column} in {_listed([str(v) for v in values])}",
        column,
        name_of(alias),
        aggregates={alias: alias},
    )


def _frame_key(kind: str, column: str, known: DataFrame, known_column: str) -> str:
    """The same for rules that compare a column with the same column of an equal plan."""
    return json.dumps([kind, column, known.semanticHash(), known_column])


def _own_name(name: str, key: str) -> str:
    """A name that rules on other tables don't have."""
    return f"{name}_{zlib.crc32(key.encode()):08x}"


def _matched_values(
    df: DataFrame, column: str, known: DataFrame, known_column: str, by: Sequence[Column], *aggregates: str
) -> DataFrame:
    """Aggregates over the distinct values of a column, of the table or of each group of ``by``.

    A value has its row count ``n`` and ``__known``, NULL where it isn't listed.

    Values are counted before the join, so a frequent value takes part as one row.
    """
    df, names = grouped(df, by)
    values = df.groupBy(*names, F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("n"))
    listed = known.select(F.col(known_column).alias("__value")).distinct().withColumn("__known", F.lit(True))
    return values.join(listed, "__value", "left").groupBy(*names).agg(*map(F.expr, aggregates))


def allowed_domain_table(column: str, domain: DataFrame, domain_column: str) -> Rule:
    """:func:`allowed_domain` for a list too long for a literal: rows whose value is not in ``domain``."""

    key = _frame_key("domain", column, domain, domain_column)
    name = _own_name("n_bad", key)
    bad = "coalesce(sum(n) FILTER (WHERE {value} IS NOT NULL AND {known} IS NULL), 0)"

    def frame(df: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
        own = bad.format(value="__value", known="__known")
        return _matched_values(df, column, domain, domain_column, by, f"coalesce(sum(n), 0) AS {ROWS}", f"{own} AS {name}")

    return _none_allowed(
        f"allowed_domain[{column}]",
        f"{column} is listed in a domain table",
        column,
        name,
        frame=frame,
        frame_key=key,
        counted=Counted((column,), {name: bad.format(value="__key0", known="{known}")}, domain.select(domain_column)),
    )


def target_distribution(column: str, low: float = 0.01, high: float = 0.99) -> Rule:
    """Share of rows with label 1; an empty table has share 0 and so fails a positive bound."""
    alias = f"positives of {column}"
    return _share_rule(
        f"target_distribution[{column}]",
        "share of the positive class is plausible",
        WARNING,
        f"[{low}, {high}]",
        name_of(alias),
        f"{{}} BETWEEN {low}D AND {high}D",
        column=column,
        columns=(column,),
        aggregates={alias: f"count_if({name_of(column)} = 1)"},
    )


def referential_integrity(column: str, reference: DataFrame, reference_column: str) -> Rule:
    """Distinct values without a match in the reference; NULL matches nothing and counts once."""

    key = _frame_key("reference", column, reference, reference_column)
    name = _own_name("n_orphans", key)

    def frame(df: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
        orphans = f"count_if(__known IS NULL) AS {name}"
        return _matched_values(df, column, reference, reference_column, by, f"coalesce(sum(n), 0) AS {ROWS}", orphans)

    return _none_allowed(
        f"referential_integrity[{column}]",
        f"{column} exists in the reference",
        column,
        name,
        frame=frame,
        frame_key=key,
        counted=Counted((column,), {name: "count_if({known} IS NULL)"}, reference.select(reference_column)),
    )


def schema_differences(actual: StructType, expected: StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(field, kind, expected, actual) for every added, removed, retyped, re-nulled or moved field."""
    have = {f.name: f for f in actual.fields}
    want = {f.name: f for f in expected.fields}
    found: list[tuple[str, str, str | None, str | None]] = []
    for name, f in want.items():
        if name not in have:
            found.append((name, "removed", f.dataType.simpleString(), None))
            continue
        other = have[name]
        if other.dataType != f.dataType:
            found.append((name, "type", f.dataType.simpleString(), other.dataType.simpleString()))
        if other.nullable != f.nullable:
            found.append((name, "nullable", str(f.nullable).lower(), str(other.nullable).lower()))
        if other.metadata != f.metadata:
            found.append((name, "metadata", str(f.metadata), str(other.metadata)))
    found += [(n, "added", None, f.dataType.simpleString()) for n, f in have.items() if n not in want]
    if not found and list(have) != list(want):
        found.append(("*", "order", _listed(list(want)), _listed(list(have))))
    return found


def schema_drift(schema: StructType, reference: StructType) -> Rule:
    """The schema must equal the reference field by field, order and nullability included."""
    changed = schema_differences(schema, reference)
    text = "; ".join(f"{name}: {kind}" for name, kind, _, _ in changed) or "unchanged"
    return Rule(
        name="schema_drift",
        description="schema equals the registered one",
        severity=CRITICAL,
        expected="unchanged",
        observed=str(len(changed)),
        observed_text=text_literal(text),
        passed=str(not changed),
    )
