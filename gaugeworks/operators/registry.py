"""Runs, model versions and aliases as append-only tables.

An alias event is (model_id, ts, event_id, action, version). ``register`` makes
the version the challenger; ``promote`` and ``rollback`` make it the champion,
and the champion before it the previous champion. State is derived from the
events, so nothing is ever updated in place and versions are never deleted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.errors import RegistryError
from gaugeworks.functions.ordered import previous_value, running_number, top_per_group

REGISTER, PROMOTE, ROLLBACK = "register", "promote", "rollback"
CHAMPION_ACTIONS = (PROMOTE, ROLLBACK)
ALIASES = ("champion", "previous_champion", "challenger")
_ORDER = ("ts", "event_id")


def alias_state(events: DataFrame, model: str = "model_id") -> DataFrame:
    """Champion, previous champion and challenger version of every model.

    Only the newest two champion events and the newest registration per model
    leave the map tasks.
    """
    kind = F.when(F.col("action").isin(*CHAMPION_ACTIONS), F.lit("champion")).when(
        F.col("action") == REGISTER, F.lit("challenger")
    )
    typed = events.select(model, *_ORDER, "version", kind.alias("kind")).where(F.col("kind").isNotNull())
    newest = top_per_group(typed, [model, "kind"], [F.desc(c) for c in _ORDER], 2, "nth")

    def version_of(alias: str, nth: int) -> Column:
        return F.max(F.when((F.col("kind") == alias) & (F.col("nth") == nth), F.col("version")))

    return newest.groupBy(model).agg(
        version_of("champion", 1).alias("champion_version"),
        version_of("champion", 2).alias("previous_champion_version"),
        version_of("challenger", 1).alias("challenger_version"),
    )


def alias_history(events: DataFrame, model: str = "model_id") -> DataFrame:
    """Every champion change with the champion it replaced.

    The changes are put in order in even ranges first, at once, so that a model or a
    day with most of them is many tasks.
    """
    changes = events.where(F.col("action").isin(*CHAMPION_ACTIONS)).select(model, *_ORDER, "action", "version")
    return previous_value(changes, [model], _ORDER, "version", None, "previous_version")


def version_by_alias(state: DataFrame, model_id, alias: str, model: str = "model_id") -> str:
    """Version behind an alias of one model, or an error."""
    if alias not in ALIASES:
        raise RegistryError(f"unknown alias {alias!r}")
    row = state.where(F.col(model) == model_id).select(f"{alias}_version").first()
    if row is None or row[0] is None:
        raise RegistryError(f"model {model_id} has no {alias}")
    return row[0]


def register_versions(runs: DataFrame, existing: DataFrame | None = None, model: str = "model_id") -> DataFrame:
    """Number new runs per model in time order, going on after the highest existing version.

    ``runs`` has (model, ts, event_id); they are put in order in even ranges first,
    at once, so a model with very many runs is many tasks.
    """
    numbered = running_number(runs, [model], _ORDER, None, "version")
    if existing is None:
        return numbered
    highest = existing.groupBy(model).agg(F.max("version").alias("__highest"))
    joined = numbered.join(highest, model, "left")
    return joined.withColumn("version", F.col("version") + F.coalesce("__highest", F.lit(0))).drop("__highest")


def promotion_plan(
    candidates: DataFrame, state: DataFrame, model: str = "model_id", confirm: bool = False
) -> DataFrame:
    """What promoting each challenger would do.

    ``candidates`` has (model, version, consistent): the version to promote and
    whether its promotion metadata checks out. Models that do not are kept, with
    an action of ``refuse``.
    """
    current = state.select(model, F.col("champion_version").alias("current_champion_version"))
    joined = candidates.join(current, model, "left")
    return joined.select(
        model,
        F.col("version").alias("challenger_version_to_promote"),
        "current_champion_version",
        F.col("current_champion_version").alias("will_set_previous_champion_to"),
        F.col("version").alias("will_set_champion_to"),
        F.when(F.coalesce("consistent", F.lit(False)), F.lit(PROMOTE)).otherwise(F.lit("refuse")).alias("action"),
        F.lit(not confirm).alias("dry_run"),
    )


def rollback_plan(
    requests: DataFrame,
    versions: DataFrame,
    state: DataFrame,
    model: str = "model_id",
    confirm: bool = False,
    dry_run: bool = False,
    smoke: DataFrame | None = None,
) -> DataFrame:
    """What each rollback request would do.

    ``requests`` has (model, target_version, author, reason, build_id) and
    ``versions`` (model, version, run_id). A target that does not exist, or, when
    the rollback is carried out, whose smoke check failed, is not applied.
    ``smoke`` has (model, version, smoke_test_passed).
    """
    execute = confirm and not dry_run
    known = versions.select(
        model, F.col("version").alias("target_version"), F.col("run_id").alias("to_run_id"), F.lit(True).alias("__known")
    )
    current = state.select(model, F.col("champion_version").alias("from_version"))
    joined = requests.join(known, [model, "target_version"], "left").join(current, model, "left")
    exists = F.coalesce("__known", F.lit(False))
    passed = F.lit(None).cast("boolean")
    if smoke is not None and execute:
        checked = smoke.select(model, F.col("version").alias("target_version"), "smoke_test_passed")
        joined = joined.join(checked, [model, "target_version"], "left")
        # Requested, so a check that was not run is a check that did not pass.
        passed = F.coalesce("smoke_test_passed", F.lit(False))
    status = (
        F.when(~exists, F.lit("target_missing"))
        .when(F.lit(not execute), F.lit("planned"))
        .when(passed == F.lit(False), F.lit("smoke_failed"))
        .otherwise(F.lit("applied"))
    )
    return joined.select(
        model,
        "from_version",
        F.col("target_version").alias("to_version"),
        "to_run_id",
        F.when(status.isin("planned", "applied"), F.col("from_version")).alias("will_set_previous_champion_to"),
        "author",
        "reason",
        "build_id",
        passed.alias("smoke_test_passed"),
        F.lit(not execute).alias("dry_run"),
        status.alias("status"),
    )


def promotion_events(plan: DataFrame, ts: Column, model: str = "model_id") -> DataFrame:
    """Alias events of the promotions a confirmed plan carries out; none for a dry run."""
    taken = plan.where((F.col("action") == PROMOTE) & ~F.col("dry_run"))
    return _events(taken, "will_set_champion_to", PROMOTE, ts, model)


def rollback_events(plan: DataFrame, ts: Column, model: str = "model_id") -> DataFrame:
    return _events(plan.where(F.col("status") == "applied"), "to_version", ROLLBACK, ts, model)


def _events(rows: DataFrame, version: str, action: str, ts: Column, model: str) -> DataFrame:
    made = rows.select(model, ts.alias("ts"), F.lit(action).alias("action"), F.col(version).alias("version"))
    return made.withColumn("event_id", F.xxhash64(model, "ts", "action", "version"))


def promotion_records(
    plan: DataFrame, recommendations: DataFrame, runs: DataFrame, approvals: DataFrame, promoted_at: Column, model: str = "model_id"
) -> DataFrame:
    """The record kept of each promotion: the plan with approver, commit, run and metrics."""
    rec = recommendations.select(model, "primary_metric", "challenger_metric", F.col("champion_metric").alias("champion_metric_before"))
    run = runs.select(model, F.col("commit").alias("git_commit"), F.col("run_id").alias("run_id"))
    approval = approvals.select(model, "approver")
    taken = plan.where(F.col("action") == PROMOTE)
    return (
        taken.join(rec, model, "left").join(run, model, "left").join(approval, model, "left")
        .withColumn("promoted_at", promoted_at)
    )


# The tags every run carries.
RUN_TAGS = (
    "project_name",
    "environment",
    "git_commit",
    "git_branch",
    "build_id",
    "build_number",
    "package_version",
    "dataset_version",
    "model_name",
    "model_framework",
    "pipeline_version",
    "training_timestamp",
    "model_alias",
)


def run_table(
    df: DataFrame, run_id: Column, params: Mapping[str, Column], metrics: Sequence[str], tags: Mapping[str, Column]
) -> DataFrame:
    """One row per run with params, numeric metrics and tags as maps.

    Hyperparameters are named ``hp_<name>`` by the caller; tags outside the fixed
    list are refused, absent ones are NULL.
    """
    unknown = [t for t in tags if t not in RUN_TAGS]
    if unknown:
        raise RegistryError(f"unknown run tag(s): {', '.join(unknown)}")

    def as_map(entries: Mapping[str, Column], kind: str) -> Column:
        pairs = [part for name, value in entries.items() for part in (F.lit(name), value.cast(kind))]
        return F.create_map(*pairs)

    return df.select(
        run_id.alias("run_id"),
        as_map(params, "string").alias("params"),
        as_map({m: F.col(m) for m in metrics}, "double").alias("metrics"),
        as_map({t: tags.get(t, F.lit(None)) for t in RUN_TAGS}, "string").alias("tags"),
    )


def with_signature(runs: DataFrame, inputs: StructType, outputs: StructType, example: DataFrame | None = None) -> DataFrame:
    """Adds what a run's model takes and gives: both schemas and a row of input, as JSON text.

    ``example`` is a frame of any size, of which one row is kept.
    """
    shown = F.lit(None).cast("string") if example is None else example.limit(1).agg(F.first(F.to_json(F.struct(*example.columns)))).scalar()
    return runs.withColumns(
        {
            "input_signature": F.lit(inputs.json()),
            "output_signature": F.lit(outputs.json()),
            "input_example": shown,
        }
    )


def run_values(runs: DataFrame) -> DataFrame:
    """The maps of a run table as rows (run_id, section, name, number, text)."""
    parts = []
    for section, number, text in (
        ("params", F.lit(None).cast("double"), F.col("value")),
        ("metrics", F.col("value"), F.lit(None).cast("string")),
        ("tags", F.lit(None).cast("double"), F.col("value")),
    ):
        rows = runs.select("run_id", F.explode(section).alias("name", "value"))
        parts.append(rows.select("run_id", F.lit(section).alias("section"), "name", number.alias("number"), text.alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
