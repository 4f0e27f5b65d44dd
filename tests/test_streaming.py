from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import rules as r
from gaugeworks.sources.keyed import KeyedTable
from gaugeworks.streaming import features as sf
from gaugeworks.streaming import sources as ss
from gaugeworks.streaming import windows as sw

SCHEMA = "id int, ts timestamp, v double"


def land(spark, path, *rows):
    df = spark.createDataFrame(list(rows), "id int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_second_run_reads_only_new_files(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = land(spark, landing, (1, "2024-01-01 00:00:00", 1.0))
    ss.to_files(ss.read_stream(spark, landing, schema), out, check)
    ss.to_files(ss.read_stream(spark, landing, schema), out, check)
    assert spark.read.parquet(out).count() == 1
    land(spark, landing, (2, "2024-01-02 00:00:00", 1.0))
    ss.to_files(ss.read_stream(spark, landing, schema), out, check)
    assert sorted(row["id"] for row in spark.read.parquet(out).collect()) == [1, 2]


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        stream = ss.with_event_time(ss.read_stream(spark, landing, schema), "ts", "1 hour")
        ss.to_files(sw.windowed_rules(stream, [r.row_count(1, 1), r.value_range("v", 0, 5)], "ts", "1 hour"), out, check)

    schema = land(spark, landing, (1, "2024-01-01 00:10:00", 1.0), (2, "2024-01-01 00:20:00", 9.0), (3, "2024-01-01 05:00:00", 1.0))
    run()
    land(spark, landing, (4, "2024-01-01 00:30:00", 9.0), (5, "2024-01-01 09:00:00", 1.0))
    run()
    found = {(str(row["window_start"])[11:16], row["rule"]): (row["status"], row["observed"]) for row in spark.read.parquet(out).collect()}
    # Row 4 came after its window was final; the window of 09:00 is still open.
    assert found == {
        ("00:00", "row_count"): ("fail", "2"),
        ("00:00", "value_range[v]"): ("fail", "1"),
        ("05:00", "row_count"): ("pass", "1"),
        ("05:00", "value_range[v]"): ("pass", "0"),
    }


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_rules_on_keys_per_window(spark, tmp_path, slide):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    known = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    rules = [r.duplicates(["id"], 0.3), r.row_count(1, 9), r.cardinality("v", 2), r.allowed_domain_table("v", known, "v"), r.referential_integrity("v", known, "v")]

    def run():
        stream = ss.with_event_time(ss.read_stream(spark, landing, schema), "ts", "10 minutes")
        ss.to_files(sw.windowed_rules(stream, rules, "ts", "1 hour", slide), out, check)

    schema = land(spark, landing, (1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:20:00", 9.0), (None, "2024-01-01 00:40:00", 9.0))
    run()
    land(spark, landing, (1, "2024-01-01 00:55:00", None), (7, "2024-01-01 05:15:00", 2.0))
    run()
    land(spark, landing, (8, "2024-01-01 09:00:00", 2.0))
    run()
    found = {}
    for row in spark.read.parquet(out).collect():
        found.setdefault(str(row["window_start"])[11:16], {})[row["rule"].split("[")[0]] = (row["status"], row["observed_num"], row["row_count"])
    assert found["00:00"] == {
        "duplicates": ("fail", 0.5, 4), "row_count": ("pass", 4.0, 4), "cardinality": ("fail", 3.0, 4),
        "allowed_domain": ("fail", 2.0, 4), "referential_integrity": ("fail", 2.0, 4),
    }
    assert found["05:00"]["duplicates"] == ("pass", 0.0, 1) and found["05:00"]["allowed_domain"] == ("pass", 0.0, 1)
    assert set(found) == ({"00:00", "05:00"} if slide is None else {"23:30", "00:00", "00:30", "04:30", "05:00"})


def test_rules_on_equal_keys_share_their_state(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    one, other = (spark.createDataFrame([(v,)], "v double") for v in (1.0, 2.0))
    listed = [r.allowed_domain_table("v", one, "v"), r.allowed_domain_table("v", other, "v")]
    rules = [r.row_count(1, 9), r.duplicates(["v"], 0.3), r.cardinality("v", 2), *listed, r.referential_integrity("v", one, "v"), r.duplicates(["id"], 0.3)]

    def suite():
        stream = ss.with_event_time(ss.read_stream(spark, landing, schema), "ts", "10 minutes")
        return sw.windowed_rules(stream, rules, "ts", "1 hour")

    schema = land(spark, landing, *[(k, "2024-01-01 00:10:00", v) for k, v in enumerate((1.0, 1.0, 1.0, 2.0, None))])
    # One pass for v and one for id.
    assert suite()._jdf.queryExecution().analyzed().toString().count("StreamingRelation") == 2
    ss.to_files(suite(), out, check)
    land(spark, landing, (9, "2024-01-01 05:00:00", 1.0))
    ss.to_files(suite(), out, check)
    found = {row["position"]: (row["rule"], row["observed_num"], row["row_count"]) for row in spark.read.parquet(out).collect()}
    assert found == {
        1: ("row_count", 5.0, 5), 2: ("duplicates[v]", 0.4, 5), 3: ("cardinality[v]", 3.0, 5), 4: ("allowed_domain[v]", 1.0, 5),
        5: ("allowed_domain[v]", 3.0, 5), 6: ("referential_integrity[v]", 2.0, 5), 7: ("duplicates[id]", 0.0, 5),
    }


def test_upsert_stream_takes_a_repeated_batch_once(spark, tmp_path):
    landing = str(tmp_path / "in")
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"])
    schema = land(spark, landing, (1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 00:00:00", 2.0))

    def run(check):
        sf.upsert_stream(ss.read_stream(spark, landing, schema), table, str(tmp_path / check), "s")

    run("c1")
    run("c2")  # a lost checkpoint delivers batch 0 again
    assert len(table.commits()) == 1
    land(spark, landing, (2, "2024-01-02 00:00:00", 5.0))
    run("c1")
    assert {row["id"]: row["v"] for row in table.read().collect()} == {1: 1.0, 2: 5.0}


def test_deduplication_across_batches(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for _ in range(2):
        schema = land(spark, landing, (1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 00:01:00", 1.0))
        stream = ss.with_event_time(ss.read_stream(spark, landing, schema), "ts", "1 hour")
        ss.to_files(sw.deduplicated(stream, ["id"]), out, check)
    assert spark.read.parquet(out).count() == 2


def test_many_copies_of_one_key_are_spread_by_file(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(4):
        schema = land(spark, landing, *[(1, "2024-01-01 00:00:00", 1.0)] * 50, (10 + k, "2024-01-01 00:00:30", 1.0))
    stream = ss.with_event_time(ss.read_stream(spark, landing, schema).withColumn("file", F.col("_metadata.file_path")), "ts", "1 hour")
    ss.to_files(sw.deduplicated(stream, ["id"], F.col("file")), out, check)
    assert sorted(row["id"] for row in spark.read.parquet(out).collect()) == [1, 10, 11, 12, 13]
    land(spark, landing, (1, "2024-01-01 00:00:10", 1.0))
    ss.to_files(sw.deduplicated(stream, ["id"], F.col("file")), out, check)
    assert spark.read.parquet(out).count() == 5
