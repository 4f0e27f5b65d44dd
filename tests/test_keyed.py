from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from gaugeworks.errors import EmptyInputError, FeatureError, SinkError, SourceError
from gaugeworks.operators.features import FeatureSpec
from gaugeworks.sources.keyed import FeatureStore, KeyedTable, snapshot_changes

SCHEMA = "k int, v string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def batch(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_upsert_replaces_and_inserts(spark, table):
    assert not table.exists()
    assert table.upsert(batch(spark, (1, "a"), (2, "b"))).row_count == 2
    table.upsert(batch(spark, (2, "c"), (3, None)))
    assert rows(table.read()) == [(1, "a"), (2, "c"), (3, None)]
    assert rows(table.read(version=0)) == [(1, "a"), (2, "b")]
    table.upsert(batch(spark, (2, "c"), (3, None)))
    assert rows(table.read()) == [(1, "a"), (2, "c"), (3, None)]


def test_null_keys_are_never_replaced(spark, table):
    table.upsert(batch(spark, (None, "a"), (1, "b")))
    table.upsert(batch(spark, (None, "a"), (None, "c")))
    assert rows(table.read()) == sorted([(1, "b"), (None, "a"), (None, "a"), (None, "c")], key=repr)


def test_refusals(spark, tmp_path, table):
    with pytest.raises(EmptyInputError):
        table.upsert(batch(spark).limit(0))
    with pytest.raises(SinkError, match="key"):
        KeyedTable(spark, str(tmp_path / "x"), []).upsert(batch(spark, (1, "a")))
    with pytest.raises(SinkError, match="more than one row"):
        table.upsert(batch(spark, (1, "a"), (1, "b")))
    assert not table.exists()  # a refused batch leaves nothing that can be read
    table.upsert(batch(spark, (1, "a")))
    with pytest.raises(SinkError, match="columns"):
        table.upsert(spark.createDataFrame([(1, 2)], "k int, other int"))
    with pytest.raises(SourceError):
        table.read(version=9)
    assert table.upsert(batch(spark, (5, "z")), dry_run=True).written is False
    assert rows(table.read()) == [(1, "a")]


def test_columns_may_come_in_another_order(spark, table):
    table.upsert(batch(spark, (1, "a")))
    table.upsert(batch(spark, (2, "b")).select("v", "k"))
    assert rows(table.read()) == [(1, "a"), (2, "b")]


def test_random_batches_against_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    table = KeyedTable(spark, str(tmp_path / "r"), ["k"])
    state = {}
    for n in range(7):
        new = {rng.randrange(20): str(rng.randrange(1000)) for _ in range(rng.randrange(1, 8))}
        table.upsert(batch(spark, *new.items()))
        state.update(new)
        if n % 3 == 2:
            table.drop_before(n)
        assert rows(table.read()) == sorted(state.items(), key=repr)
    assert table.versions() == [5, 6]


def test_repeated_source_batch_is_skipped(spark, table):
    table.upsert(batch(spark, (1, "a")), source="s", source_batch=0)
    assert table.upsert(batch(spark, (1, "b")), source="s", source_batch=0).written is False
    table.upsert(batch(spark, (1, "c")), source="other", source_batch=0)
    assert rows(table.read()) == [(1, "c")]


def test_changes(spark, table):
    table.upsert(batch(spark, (1, "a"), (2, "b")))
    table.upsert(batch(spark, (2, "b"), (3, "c")))
    table.upsert(batch(spark, (1, "x"), (3, "d"), (None, "n")))
    select = ("k", "v", "_change_type", "_commit_version")
    expected = [
        (1, "a", "update_preimage", 2),
        (1, "x", "update_postimage", 2),
        (3, "c", "insert", 1),
        (3, "c", "update_preimage", 2),
        (3, "d", "update_postimage", 2),
        (None, "n", "insert", 2),
    ]
    assert rows(table.changes(1).select(*select)) == sorted(expected, key=repr)
    assert len(rows(table.changes(0))) == 2 + len(expected)
    table.drop_before(1)
    assert rows(table.changes(2).select(*select)) == sorted((e for e in expected if e[3] == 2), key=repr)
    with pytest.raises(SourceError):
        table.changes(1)  # the version before is gone
    with pytest.raises(SourceError):
        table.changes()
    with pytest.raises(SourceError):
        table.changes(9)


def test_changes_by_time_and_version_wins(spark, table):
    table.upsert(batch(spark, (1, "a")))
    table.upsert(batch(spark, (1, "b")))
    second = table.commit(1).committed_at
    assert second.tzinfo is not None
    assert len(rows(table.changes(starting_timestamp=second))) == 2
    assert len(rows(table.changes(starting_version=0, starting_timestamp=second))) == 3
    with pytest.raises(SourceError):
        table.changes(starting_timestamp=second + timedelta(days=1))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert len(rows(table.changes(starting_timestamp=second))) == 2
            local = second.astimezone(ZoneInfo(name)).replace(tzinfo=None)
            assert len(rows(table.changes(starting_timestamp=local))) == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_second_writer_of_a_version_fails(spark, table):
    table.upsert(batch(spark, (1, "a")))
    first, second = (KeyedTable(spark, table.path, ["k"]) for _ in range(2))
    second.versions = lambda: [0]
    first.upsert(batch(spark, (2, "b")))
    with pytest.raises(SinkError, match="another writer"):
        second.upsert(batch(spark, (3, "c")))
    assert rows(table.read()) == [(1, "a"), (2, "b")]
    table.upsert(batch(spark, (3, "c")))
    assert [c.version for c in table.commits()] == [0, 1, 2] and table.read().count() == 3
    assert [t.name for t in spark.catalog.listTables(table.database)] == ["v0", "v1", "v2"]


def test_only_the_batch_is_shuffled(spark, table):
    table.upsert(batch(spark, *((k, str(k)) for k in range(200))))
    plan = table._merged(batch(spark, (1, "z")), 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    table.upsert(batch(spark, (1, "z")))
    feed = table.changes(1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in feed


def test_names_with_quotes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "q"), ["a key"])
    for n in range(2):
        table.upsert(spark.createDataFrame([(1, n)], "`a key` int, `it's` int"), source="it's \\ \"x\"", source_batch=n)
    assert rows(table.read()) == [(1, 1)] and table.commit(1).sources == {"it's \\ \"x\"": 1}


def test_other_types_are_refused_before_anything_is_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "n"), ["k"])
    table.upsert(spark.createDataFrame([(1, 1.0)], "k bigint, v double"))
    for schema, row in (("k bigint, v string", (2, "x")), ("k string, v double", ("2", 1.0))):
        with pytest.raises(SinkError, match="types"):
            table.upsert(spark.createDataFrame([row], schema))
    table.upsert(spark.createDataFrame([(2, 2.0)], "k int, v float"))
    assert rows(table.read()) == [(1, 1.0), (2, 2.0)] and table.read().dtypes == [("k", "bigint"), ("v", "double")]


def test_snapshot_changes(spark):
    before = batch(spark, (1, "a"), (2, None), (3, "c"), (None, "n"))
    after = batch(spark, (1, "a"), (2, "b"), (4, None), (None, "m"))
    found = snapshot_changes(before, after, ["k"], 5)
    assert rows(found.select("k", "v", "_change_type")) == sorted(
        [
            (2, None, "update_preimage"),
            (2, "b", "update_postimage"),
            (3, "c", "delete"),
            (4, None, "insert"),
            (None, "n", "delete"),
            (None, "m", "insert"),
        ],
        key=repr,
    )
    assert {r["_commit_version"] for r in found.collect()} == {5}
    assert snapshot_changes(before.where("k IS NOT NULL"), before.where("k IS NOT NULL"), ["k"]).count() == 0


def test_snapshot_changes_by_digest_and_without(spark):
    rng = random.Random(4)
    cell = lambda: rng.choice([None, "", "a", "b"])
    before = {k: (cell(), cell()) for k in range(300)}
    after = {k: (cell(), cell()) if rng.random() < 0.1 else v for k, v in before.items() if rng.random() < 0.95} | {900: (None, None)}
    # The same values in other columns, and in other rows of a bucket.
    after[5], after[6] = before[5][::-1], before[7]
    frames = [spark.createDataFrame([(k, *v) for k, v in state.items()], "k int, v string, w string") for state in (before, after)]
    whole = rows(snapshot_changes(*frames, ["k"], digests=0))
    for digests in (1, 16, 4096):
        assert rows(snapshot_changes(*frames, ["k"], digests=digests)) == whole
    kinds = {(r[0], r[1]) for r in whole}
    assert kinds == {(k, "delete") for k in before.keys() - after.keys()} | {(900, "insert")} | {
        (k, kind) for k in before.keys() & after.keys() if before[k] != after[k] for kind in ("update_preimage", "update_postimage")
    }


def shuffled_rows(df) -> list[int]:
    """Rows written by each exchange of a frame that has run."""
    found: list[int] = []

    def walk(node):
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        for n in range(node.children().size()):
            walk(node.children().apply(n))

    walk(df._jdf.queryExecution().executedPlan())
    return sorted(found)


def test_unchanged_buckets_are_not_shuffled(spark):
    before = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    after = before.withColumn("v", F.when(F.col("k") == 77, 100).otherwise(F.col("v")))
    changes = snapshot_changes(before, after, ["k"], digests=500)
    assert len(changes.collect()) == 2
    # The rows of one bucket of each state, and a digest per bucket and task.
    one, other, digests = shuffled_rows(changes)
    assert one == other < 100 and digests <= 500 * 8
    whole = snapshot_changes(before, after, ["k"], digests=0)
    assert len(whole.collect()) == 2 and shuffled_rows(whole) == [20_000, 20_000]


def test_feature_store(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    spec = FeatureSpec("a.b", ("k",), ("v",))
    with pytest.raises(FeatureError):
        store.read(spec)
    store.write(batch(spark, (1, "a"), (2, "b")), spec)
    store.write(batch(spark, (1, "a"), (2, "b")), spec)
    assert store.read(spec).count() == 2
    labels = spark.createDataFrame([(1, 0), (9, 1)], "k int, y int")
    assert rows(store.training_set(labels, spec, "y")) == [(1, 0, "a")]
    assert rows(store.lookup(labels.select("k"), spec)) == [(1, "a"), (9, None)]


def test_commit_times_are_utc(spark, table):
    table.upsert(batch(spark, (1, "a")))
    age = datetime.now(timezone.utc) - table.commits()[0].committed_at.replace(tzinfo=timezone.utc)
    assert abs(age.total_seconds()) < 600
