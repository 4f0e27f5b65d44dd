from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.errors import NotApprovedError, RegistryError
from gaugeworks.operators import promotion as p
from gaugeworks.operators import registry as g

METRICS = "model_id int, role string, accuracy double, precision double, recall double, f1_score double, roc_auc double"
POLICY = p.PromotionPolicy(dict.fromkeys(p.METRICS, 0.5), max_regression=0.05)


def metrics(spark, *rows):
    """(model, role, f1, the other metrics)"""
    return spark.createDataFrame([(m, role, x, x, x, f1, x) for m, role, f1, x in rows], METRICS)


def decide(df, policy=POLICY):
    return {r["model_id"]: r for r in p.recommend(p.pair_roles(df, "model_id", F.col("role")), policy).collect()}


def test_decisions(spark):
    found = decide(
        metrics(
            spark,
            (1, "challenger", 0.9, 0.9),  # first model
            (2, "challenger", 0.1, 0.1),  # below the minima
            (3, "champion", 0.9, 0.9),
            (3, "challenger", 0.8, 0.9),  # fell too far
            (4, "champion", 0.9, 0.9),
            (4, "challenger", 0.895, 0.9),  # fell, within the limit
            (5, "champion", 0.9, 0.9),  # no challenger
            (6, "champion", 0.0, 0.9),
            (6, "challenger", 0.7, 0.9),
        )
    )
    assert {m: r["recommendation"] for m, r in found.items()} == {1: "promote", 2: "reject", 3: "reject", 4: "promote", 6: "promote"}
    assert found[1]["is_first_model"] and found[1]["absolute_improvement"] is None
    assert not found[3]["regression_within_limit"] and found[3]["absolute_approval"]
    assert (found[3]["absolute_improvement"], found[3]["relative_improvement"]) == (-0.1, -0.111111)
    assert found[6]["relative_improvement"] is None  # champion at zero
    assert found[2]["absolute_failures"] == list(p.METRICS)


def test_versions_are_carried_along(spark):
    df = metrics(spark, (1, "challenger", 0.9, 0.9), (3, "champion", 0.9, 0.9), (3, "challenger", 0.8, 0.9)).withColumn(
        "version", F.concat(F.lit("v-"), "role")
    )
    by_role = p.pair_roles(df, "model_id", F.col("role"), carry=["version"])
    by_table = p.pair_tables(df.where("role = 'challenger'"), df.where("role = 'champion'"), "model_id", carry=["version"])
    for pairs in (by_role, by_table):
        found = {r["model_id"]: (r["champion_version"], r["challenger_version"]) for r in pairs.collect()}
        assert found == {1: (None, "v-challenger"), 3: ("v-champion", "v-challenger")}


def test_two_tables_decide_alike(spark):
    df = metrics(spark, (1, "challenger", 0.9, 0.9), (3, "champion", 0.9, 0.9), (3, "challenger", 0.8, 0.9))
    pairs = p.pair_tables(df.where("role = 'challenger'"), df.where("role = 'champion'"), "model_id")
    found = {r["model_id"]: r["recommendation"] for r in p.recommend(pairs, POLICY).collect()}
    assert found == {m: r["recommendation"] for m, r in decide(df).items()}


def test_missing_metrics(spark):
    df = metrics(spark, (1, "challenger", 0.9, 0.9), (2, "challenger", 0.9, None), (3, "challenger", None, None))
    assert {m: r["recommendation"] for m, r in decide(df).items()} == {1: "promote", 2: "reject", 3: "reject"}
    skipping = p.PromotionPolicy(POLICY.minima, missing="skip")
    assert {m: r["recommendation"] for m, r in decide(df, skipping).items()} == {1: "promote", 2: "promote", 3: "reject"}


def test_minimum_improvement_is_off_by_default(spark):
    df = metrics(spark, (1, "champion", 0.9, 0.9), (1, "challenger", 0.9, 0.9))
    assert decide(df)[1]["recommendation"] == "promote"
    strict = p.PromotionPolicy(POLICY.minima, minimum_improvement=0.01)
    assert decide(df, strict)[1]["recommendation"] == "reject"


def test_enforcement_names_the_rejected(spark):
    df = spark.createDataFrame([(1, "promote"), (7, "reject")], "model_id int, recommendation string")
    with pytest.raises(NotApprovedError, match="7"):
        p.enforce_approval(df, "model_id")
    p.enforce_approval(df.where("model_id = 1"), "model_id")


def test_metric_gate(spark):
    df = metrics(spark, (1, "x", 0.9, 0.9), (2, "x", None, 0.9), (3, "x", 0.4, 0.9)).withColumn(
        "bad", F.when(F.col("model_id") == 1, 0.02)
    )
    found = {r["model_id"]: r["failures"] for r in p.metric_gate(df, POLICY.minima, "bad").collect()}
    assert found == {1: ["invalid_predictions:above_maximum"], 2: ["f1_score:missing"], 3: ["f1_score:below_minimum"]}
    assert p.metric_gate(df, POLICY.minima).where("passed").count() == 1


def test_metadata(spark):
    rec = spark.createDataFrame(
        [(1, "promote", True, 5, "r", "c"), (2, "reject", False, 5, "r", "c"), (3, "promote", True, 5, "r", None)],
        "m int, recommendation string, technical_approval boolean, version int, run_id string, commit string",
    )
    runs = spark.createDataFrame([(1, "5", "r", "c"), (2, "6", "q", "d")], "m int, version string, run_id string, commit string")
    approvals = spark.createDataFrame([(1, "jo", "5", "r"), (2, "", "5", "r")], "m int, approver string, version string, run_id string")
    found = {r["m"]: r for r in p.promotion_metadata_check(rec, runs, approvals, "m").collect()}
    assert found[1]["consistent"]  # 5 and '5' are the same version
    assert len(found[2]["problems"]) == 8
    # No run and no approval: the commits are both absent and so equal.
    assert found[3]["problems"] == ["version_differs_from_run", "run_id_differs_from_run", "no_approver"]


def test_manifest(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two")):
        (tmp_path / name).write_text(text)
    digests = p.file_digests(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("artifact"), "sha256")
    assert dict(digests.collect())["a"] == hashlib.sha256(b"one").hexdigest()
    expected = spark.createDataFrame(
        [("a", hashlib.sha256(b"one").hexdigest()), ("b", "x"), ("c", "y")], "artifact string, sha256 string"
    )
    found = {r["artifact"]: r["intact"] for r in p.manifest_check(expected, digests, "artifact").collect()}
    assert found == {"a": True, "b": False, "c": False}


def test_digests_of_files_larger_than_a_row(spark, tmp_path):
    rng = random.Random(2)
    contents = {f"part {k}.bin": rng.randbytes(size) for k, size in enumerate((1, 10, 1000, 1001, 5000, 70_000))}
    (tmp_path / "deep er").mkdir()
    for k, (name, data) in enumerate(contents.items()):
        (tmp_path / ("deep er" if k % 2 else "") / name).write_bytes(data)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        rows = p.file_digests(spark, str(tmp_path), whole_bytes=1000, piece_bytes=999).collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    found = {row["path"].rsplit("/", 1)[1].replace("%20", " "): row["sha256"] for row in rows}
    assert found == {name: hashlib.sha256(data).hexdigest() for name, data in contents.items()}


def test_one_model_with_all_events_is_many_tasks(spark):
    events = spark.range(4000).selectExpr(
        "1 AS model_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "id AS event_id", "'promote' AS action", "string(id) AS version"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_one_model(g.alias_history(events), events)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_one_model(history, events):
    sizes = [r["n"] for r in history.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2500 and len(sizes) > 1
    found = {r["event_id"]: r["previous_version"] for r in history.collect()}
    assert found == {k: str(k - 1) if k else None for k in range(4000)}
    numbers = g.register_versions(events.select("model_id", "ts", "event_id"))
    assert {r["event_id"]: r["version"] for r in numbers.collect()} == {k: k + 1 for k in range(4000)}


EVENTS = "model_id int, ts timestamp_ntz, event_id bigint, action string, version string"


@pytest.fixture
def events(spark):
    rows = [
        (1, "2024-01-01", 1, "register", "1"),
        (1, "2024-01-02", 2, "promote", "1"),
        (1, "2024-01-02", 3, "register", "2"),
        (1, "2024-01-05", 4, "promote", "2"),
        (2, "2024-01-01", 5, "register", "1"),
    ]
    return spark.createDataFrame(rows, EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def state_of(events):
    return {r["model_id"]: tuple(r)[1:] for r in g.alias_state(events).collect()}


def test_alias_state_and_history(events):
    assert state_of(events) == {1: ("2", "1", "2"), 2: (None, None, "1")}
    history = [(r["version"], r["previous_version"]) for r in g.alias_history(events).orderBy("ts").collect()]
    assert history == [("1", None), ("2", "1")]
    state = g.alias_state(events)
    assert g.version_by_alias(state, 1, "previous_champion") == "1"
    for model, alias in ((2, "champion"), (9, "champion"), (1, "no_such_alias")):
        with pytest.raises(RegistryError):
            g.version_by_alias(state, model, alias)


def test_promotion(spark, events):
    candidates = spark.createDataFrame([(1, "2", False), (2, "1", True)], "model_id int, version string, consistent boolean")
    state = g.alias_state(events)
    dry = {r["model_id"]: r for r in g.promotion_plan(candidates, state).collect()}
    assert (dry[1]["action"], dry[2]["action"], dry[2]["dry_run"]) == ("refuse", "promote", True)
    later = F.lit("2024-02-01").cast("timestamp_ntz")
    assert g.promotion_events(g.promotion_plan(candidates, state), later).count() == 0
    confirmed = g.promotion_events(g.promotion_plan(candidates, state, confirm=True), later)
    # The first champion of model 2; its challenger alias stays.
    assert state_of(events.unionByName(confirmed)) == {1: ("2", "1", "2"), 2: ("1", None, "1")}


def test_promotion_record(spark, events):
    candidates = spark.createDataFrame([(2, "1", True)], "model_id int, version string, consistent boolean")
    plan = g.promotion_plan(candidates, g.alias_state(events), confirm=True)
    rec = spark.createDataFrame([(2, "f1_score", 0.9, None)], "model_id int, primary_metric string, challenger_metric double, champion_metric double")
    runs = spark.createDataFrame([(2, "c", "r")], "model_id int, commit string, run_id string")
    approvals = spark.createDataFrame([(2, "jo")], "model_id int, approver string")
    row = g.promotion_records(plan, rec, runs, approvals, F.lit("2024-02-01")).first()
    assert (row["approver"], row["git_commit"], row["run_id"], row["champion_metric_before"]) == ("jo", "c", "r", None)


def test_rollback(spark, events):
    requests = spark.createDataFrame(
        [(1, "1", "a", "r", "b"), (2, "7", "a", "r", "b")],
        "model_id int, target_version string, author string, reason string, build_id string",
    )
    versions = spark.createDataFrame([(1, "1", "run-1"), (1, "2", "run-2"), (2, "1", "run-3")], "model_id int, version string, run_id string")
    state = g.alias_state(events)
    later = F.lit("2024-02-01").cast("timestamp_ntz")

    def plan(**options):
        return g.rollback_plan(requests, versions, state, **options)

    def statuses(df):
        return {r["model_id"]: r["status"] for r in df.collect()}

    assert statuses(plan()) == {1: "planned", 2: "target_missing"}
    assert statuses(plan(confirm=True, dry_run=True)) == {1: "planned", 2: "target_missing"}
    assert g.rollback_events(plan(confirm=True, dry_run=True), later).count() == 0
    failing = spark.createDataFrame([(1, "1", False)], "model_id int, version string, smoke_test_passed boolean")
    assert statuses(plan(confirm=True, smoke=failing))[1] == "smoke_failed"
    assert statuses(plan(confirm=True, smoke=failing.limit(0)))[1] == "smoke_failed"
    applied = plan(confirm=True)
    row = applied.where("model_id = 1").first()
    assert (row["from_version"], row["to_version"], row["to_run_id"], row["status"]) == ("2", "1", "run-1", "applied")
    assert state_of(events.unionByName(g.rollback_events(applied, later)))[1] == ("1", "2", "2")


def test_version_numbers_go_on(spark, events):
    runs = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "model_id int, event_id bigint").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    existing = spark.createDataFrame([(1, 4)], "model_id int, version bigint")
    found = {r["event_id"]: r["version"] for r in g.register_versions(runs, existing).collect()}
    assert found == {10: 5, 11: 6, 12: 1}


def test_run_table(spark):
    df = spark.createDataFrame([(1, 0.5)], "id int, f1_score double")
    runs = g.run_table(df, F.col("id").cast("string"), {"hp_x": F.lit(3)}, ["f1_score"], {"environment": F.lit("dev")})
    row = runs.first()
    assert row["params"] == {"hp_x": "3"} and row["metrics"] == {"f1_score": 0.5}
    assert set(row["tags"]) == set(g.RUN_TAGS) and row["tags"]["environment"] == "dev"
    assert g.run_values(runs).count() == 2 + len(g.RUN_TAGS)
    with pytest.raises(RegistryError):
        g.run_table(df, F.lit("1"), {"a": F.lit(1)}, [], {"no_such_tag": F.lit(1)})
