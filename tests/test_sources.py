from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gaugeworks import workspace
from gaugeworks.errors import ConfigError, EmptyInputError, SchemaError, SinkError, SourceError
from gaugeworks.sources import readers as rd
from gaugeworks.sources import writers as wr


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a,b"), (2, None)], "id bigint, text string")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_text_formats_need_a_schema(spark, tmp_path):
    for read in (rd.read_csv, rd.read_json):
        with pytest.raises(SourceError, match="schema"):
            read(spark, str(tmp_path))


def test_csv_and_json(spark, rows, tmp_path):
    csv, json = str(tmp_path / "csv"), str(tmp_path / "json")
    assert wr.write_csv(rows, csv, wr.WriteOptions(), sep="|").row_count == 2
    assert same(rd.read_csv(spark, csv, rows.schema, sep="|"), rows)
    assert rd.read_csv(spark, csv, allow_schema_inference=True, sep="|").columns == ["id", "text"]
    assert wr.write_json(rows, json, wr.WriteOptions()).row_count == 2
    assert same(rd.read_json(spark, json, rows.schema), rows)
    assert set(rd.read_json(spark, json, allow_schema_inference=True).columns) == {"id", "text"}


def test_failures_are_source_errors(spark, tmp_path):
    with pytest.raises(SourceError):
        rd.read_parquet(spark, str(tmp_path / "gone"))
    with pytest.raises(SourceError):
        rd.read_table(spark, "no_such_table")
    with pytest.raises(SourceError):
        rd.read_path(spark, str(tmp_path), "no_such_format")
    with pytest.raises(ConfigError):
        rd.load(spark, rd.Source("no_such_kind", "x"))


def test_jdbc_needs_credentials(spark, rows):
    for properties in ({}, {"user": "u"}, {"user": "u", "password": ""}):
        with pytest.raises(SourceError, match="password"):
            rd.read_jdbc(spark, "jdbc:x", "t", properties)
        # Refused before the frame is looked at: an empty one makes no difference.
        with pytest.raises(SinkError, match="password"):
            wr.write_jdbc(rows.limit(0), "jdbc:x", "t", properties, wr.WriteOptions())


def test_jdbc_partition_options():
    options = rd.JdbcPartitions("id", 0, 100, 8).options()
    assert options == {"partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}
    with pytest.raises(ConfigError):
        rd.JdbcPartitions("id", 0, 100, 0).options()


def test_schema_validation_ignores_extras_and_nullability(rows):
    rd.validate_schema(rows, StructType([StructField("id", LongType(), False)]))
    with pytest.raises(SchemaError, match="id: expected string, found bigint, other: expected bigint, found nothing"):
        rd.validate_schema(rows, StructType([StructField("id", StringType()), StructField("other", LongType())]))


def test_require_non_empty(rows):
    assert rd.require_non_empty(rows, "rows") is rows
    with pytest.raises(EmptyInputError):
        rd.require_non_empty(rows.limit(0), "rows")


def test_guards_in_order(rows, tmp_path):
    path = str(tmp_path / "t")
    prd = wr.WriteOptions("overwrite", environment="prd")
    with pytest.raises(SinkError, match="unknown write mode"):
        wr.write_parquet(rows.limit(0), path, wr.WriteOptions("replace"))
    with pytest.raises(EmptyInputError):
        wr.write_parquet(rows.limit(0), path, prd)
    with pytest.raises(SinkError, match="allow_prd_overwrite"):
        wr.write_parquet(rows, path, wr.WriteOptions("overwrite", ("gone",), "prd"))
    with pytest.raises(SinkError, match="gone"):
        wr.write_parquet(rows, path, wr.WriteOptions("overwrite", ("gone",)))
    assert not os.path.exists(path)
    allowed = wr.WriteOptions("overwrite", environment="prd", allow_prd_overwrite=True)
    assert wr.write_parquet(rows, path, allowed).row_count == 2


def test_dry_run_counts_and_writes_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "dry")
    result = wr.write_parquet(rows, path, wr.WriteOptions(dry_run=True))
    assert (result.row_count, result.written) == (2, False)
    assert not os.path.exists(path)
    wr.write_table(rows, "dry_table", wr.WriteOptions(dry_run=True))
    assert not spark.catalog.tableExists("dry_table")


def test_modes(rows, tmp_path):
    path = str(tmp_path / "m")
    assert wr.write_parquet(rows, path, wr.WriteOptions("append")).row_count == 2
    assert wr.write_parquet(rows, path, wr.WriteOptions("append")).row_count == 2
    ignored = wr.write_parquet(rows, path, wr.WriteOptions("ignore"))
    assert (ignored.row_count, ignored.written) == (0, False)
    with pytest.raises(SinkError):
        wr.write_parquet(rows, path, wr.WriteOptions("errorifexists"))
    assert wr.write_parquet(rows, path, wr.WriteOptions("overwrite")).row_count == 2


def test_managed_table(spark, rows):
    result = wr.write_table(rows, "managed_rows", wr.WriteOptions("overwrite", ("id",)))
    assert result.row_count == 2
    assert same(rd.load(spark, rd.Source("table", "managed_rows")).select("id", "text"), rows)
    spark.sql("DROP TABLE managed_rows")


def test_report_run_can_be_repeated(spark, rows, tmp_path):
    path = str(tmp_path / "report")
    for run in ("a", "b", "b"):
        wr.write_report(rows, path, run)
    counts = dict(spark.read.parquet(path).groupBy("run_id").count().collect())
    assert counts == {"a": 2, "b": 2}


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert workspace.shared_folder(spark) == named
    assert workspace.fresh_path(spark, "x").startswith(named)
    assert workspace.fresh_path(spark, "x") != workspace.fresh_path(spark, "x")


def test_partition_filter_reads_one_directory(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    wr.write_parquet(rows, path, wr.WriteOptions(partition_by=("id",)))
    plan = spark.read.parquet(path).where(F.col("id") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id" in plan


def test_delta_is_refused_without_delta(spark, rows, tmp_path):
    from gaugeworks.sources import delta

    assert not delta.has_delta(spark)
    with pytest.raises(SinkError):
        delta.merge_into(rows, str(tmp_path), ["id"])
    with pytest.raises(SourceError):
        delta.read_changes(spark, str(tmp_path), 0)


@pytest.mark.parametrize("write", [wr.write_parquet, wr.write_json, wr.write_csv])
def test_only_the_files_a_write_added_are_counted(spark, rows, tmp_path, monkeypatch, write):
    path = str(tmp_path / "grown")
    append = wr.WriteOptions("append")
    counts = []
    for _ in range(3):
        opened = []
        add = wr._by_path

        def listed(*args, **settings):
            found = add(*args, **settings)
            return {**found, "rows_in": lambda files: opened.append(files) or found["rows_in"](files)}

        monkeypatch.setattr(wr, "_by_path", listed)
        counts.append(write(rows.unionByName(rows), path, append).row_count)
        monkeypatch.setattr(wr, "_by_path", add)
        (files,) = opened
        assert len(set(files)) == len(files) and len(files) < 10
    assert counts == [2 * rows.count()] * 3
    assert write(rows, path, wr.WriteOptions("append", count_rows=False)).row_count is None


def test_rows_with_line_breaks_are_counted_once(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1), ("c", 2)], "t string, n int")
    assert wr.write_csv(df, str(tmp_path / "c"), wr.WriteOptions()).row_count == 2
    assert wr.write_json(df, str(tmp_path / "j"), wr.WriteOptions()).row_count == 2

