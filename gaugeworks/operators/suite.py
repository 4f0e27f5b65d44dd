"""Running many rules over one table in as few passes as possible."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.errors import QualityGateError
from gaugeworks.functions.columns import rows_from_sql, struct_sql, text_literal
from gaugeworks.operators import rules as r

RESULT_COLUMNS = (
    "position",
    "rule",
    "description",
    "column",
    "severity",
    "blocking",
    "status",
    "observed",
    "expected",
    "observed_num",
    "row_count",
)


class QualitySuite:
    """An ordered list of rules.

    ``evaluate`` plans one aggregation over the table for all rules that need no
    shuffle and one keyed aggregation per distinct key set for the others. It
    returns a lazy DataFrame with one row per rule.
    """

    def __init__(self, rules: Sequence[r.Rule]):
        self.rules = list(rules)

    def active_rules(self, schema: StructType) -> list[r.Rule]:
        """Rules that apply to this schema: none but the failed gate when a gate fails."""
        for rule in self.rules:
            if rule.gate is not None and not rule.gate(schema):
                return [rule]
        return [rule for rule in self.rules if all(c in schema.names for c in rule.columns)]

    @staticmethod
    def aggregates(rules: Sequence[r.Rule]) -> list[Column]:
        """The aggregate expressions of the rules, each once, with the row count first."""
        named = {r.ROWS: "count(1)"}
        for rule in rules:
            named.update(rule.aggregates)
        return [F.expr(sql).alias(name) for name, sql in named.items()]

    @staticmethod
    def verdicts(row: DataFrame, rules: Sequence[tuple[int, r.Rule]], keep: Sequence[str] = ()) -> DataFrame:
        """One row per rule from a row of aggregates, the ``keep`` columns repeated."""
        scalars = {name: value for _, rule in rules for name, value in rule.scalars.items()}
        if scalars:
            row = row.withColumns(scalars)
        blocking = ", ".join(text_literal(s) for s in r.BLOCKING)
        structs = []
        for position, rule in rules:
            failed = f"NOT coalesce({rule.passed}, false)"
            severity = rule.severity_sql or text_literal(rule.severity)
            structs.append(
                struct_sql(
                    position=str(position),
                    rule=text_literal(rule.name),
                    description=text_literal(rule.description),
                    column="string(NULL)" if rule.column is None else text_literal(rule.column),
                    severity=severity,
                    blocking=f"{failed} AND {severity} IN ({blocking})",
                    status=f"if({failed}, 'fail', 'pass')",
                    observed=rule.observed_text or f"string({rule.observed})",
                    expected=rule.expected_sql or text_literal(rule.expected),
                    observed_num=f"double({rule.observed})",
                    row_count=r.ROWS,
                )
            )
        return row.select(*keep, rows_from_sql(structs))

    def evaluate(self, df: DataFrame, at: Column | None = None) -> DataFrame:
        """The verdicts; ``at`` adds the time of the run as ``evaluated_at``."""
        passes: dict[str | None, list[tuple[int, r.Rule]]] = {}
        for position, rule in enumerate(self.active_rules(df.schema), start=1):
            passes.setdefault(rule.frame_key, []).append((position, rule))
        results = None
        for key, members in passes.items():
            if key is None:
                row = df.agg(*self.aggregates([rule for _, rule in members]))
            else:
                row = members[0][1].frame(df)
            part = self.verdicts(row, members)
            results = part if results is None else results.unionByName(part)
        return results if at is None else results.withColumn("evaluated_at", at)


def table_suite(
    schema: StructType,
    *,
    required: Sequence[str],
    key: str,
    domains: dict[str, Sequence] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
    target: str | None = None,
    previous_rows: int | Column | None = None,
    reference_schema: StructType | None = None,
    max_null_share: float = 0.05,
    max_duplicate_share: float = 0.01,
    min_rows: int = 1,
    max_rows: int = 100_000_000,
    max_volume_change: float = 0.5,
) -> QualitySuite:
    """The standard order: columns, volume, duplicates, nulls, domains, ranges, target, schema."""
    rules = [
        r.required_columns(schema, required),
        r.extra_columns(schema, required),
        r.row_count(min_rows, max_rows),
        r.volume_change(previous_rows, max_volume_change),
        r.duplicates([key], max_duplicate_share),
    ]
    rules += [r.null_percentage(c, max_null_share) for c in required]
    rules += [r.allowed_domain(c, values) for c, values in (domains or {}).items()]
    rules += [r.value_range(c, low, high) for c, (low, high) in (ranges or {}).items()]
    if target is not None:
        rules.append(r.target_distribution(target))
    if reference_schema is not None:
        rules.append(r.schema_drift(schema, reference_schema))
    return QualitySuite(rules)


def failed_rules(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "fail")


def blocking_failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("blocking"))


def summarize(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per run: passed, row count, numbers of rules, failures and blocking failures."""
    return results.groupBy(*by).agg(
        (F.count_if(F.col("blocking")) == 0).alias("passed"),
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("n_rules"),
        F.count_if(F.col("status") == "fail").alias("n_failed"),
        F.count_if(F.col("blocking")).alias("n_blocking"),
    )


@dataclass(frozen=True)
class GateOutcome:
    passed: bool
    failed_rules: tuple[str, ...]


def check_gate(results: DataFrame) -> GateOutcome:
    """Run the suite and name the blocking rules that failed; one row per rule at most."""
    names = [row["rule"] for row in blocking_failures(results).orderBy("position").select("rule").collect()]
    return GateOutcome(not names, tuple(names))


def enforce_gate(results: DataFrame) -> None:
    outcome = check_gate(results)
    if not outcome.passed:
        raise QualityGateError(
            f"{len(outcome.failed_rules)} blocking rule(s) failed: {', '.join(outcome.failed_rules)}",
            outcome.failed_rules,
        )


def gate_reports(rule_rows: DataFrame, reports: DataFrame, run: str = "run_id") -> DataFrame:
    """Re-check stored reports, one row per run.

    A run fails on any blocking failure among its rules, and also when the report
    itself says it did not pass or does not say.
    """
    bad = F.when(
        (F.col("status") == "fail") & F.col("severity").isin(*r.BLOCKING), F.col("rule")
    )
    per_run = rule_rows.groupBy(run).agg(F.count(bad).alias("__bad"))
    found = F.coalesce("__bad", F.lit(0))
    return reports.join(per_run, run, "left").select(
        run,
        "row_count",
        found.alias("n_blocking"),
        (F.coalesce("passed", F.lit(False)) & (found == 0)).alias("gate_passed"),
    )


def previous_row_count(reports: DataFrame, order: str) -> Column:
    """Row count of the latest stored report, as a scalar for :func:`rules.volume_change`."""
    return reports.agg(F.max_by("row_count", order)).scalar()
