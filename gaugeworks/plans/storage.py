"""Reading, writing, keyed tables and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.profile import ProfileSpec, profile
from gaugeworks.operators.rules import null_percentage, row_count
from gaugeworks.operators.suite import QualitySuite
from gaugeworks.plans import inputs as i
from gaugeworks.plans.sql import over
from gaugeworks.sources import readers, writers
from gaugeworks.sources.keyed import KeyedTable, snapshot_changes
from gaugeworks.workspace import fresh_path


def _money(column: str) -> F.Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def src_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i.table(spark, sf_dir, "orders").createOrReplaceTempView("gaugeworks_orders")
    orders = readers.read_table(spark, "gaugeworks_orders")
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(_money("o_totalprice"), 2).alias("total_price")
    )


def src_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.load(spark, readers.Source("parquet", f"{sf_dir}/lineitem.parquet"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_lines"))


def src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = i.table(spark, sf_dir, "customer")
    path = fresh_path(spark, "csv")
    writers.write_csv(customers, path, writers.WriteOptions(), sep=";")
    return readers.read_csv(spark, path, customers.schema, sep=";")


def src_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = i.table(spark, sf_dir, "orders")
    path = fresh_path(spark, "json")
    writers.write_json(orders, path, writers.WriteOptions())
    back = readers.read_json(spark, path, orders.schema)
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def sink_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "table")
    name = "gaugeworks_" + path.rsplit("-", 1)[1]
    parts = i.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    writers.write_table(parts, name, writers.WriteOptions(), path=path)
    return readers.read_table(spark, name)


def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write orders by status and read one status back; the filter picks directories."""
    path = fresh_path(spark, "partitioned")
    options = writers.WriteOptions(partition_by=("o_orderstatus",))
    writers.write_parquet(i.table(spark, sf_dir, "orders"), path, options)
    finished = readers.read_parquet(spark, path).where(F.col("o_orderstatus") == "F")
    return finished.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))


def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "append")
    for _ in range(2):
        writers.write_parquet(i.table(spark, sf_dir, "orders"), path, writers.WriteOptions("append"))
    return readers.read_parquet(spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))


def report_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in one report table, the second one written twice."""
    path = fresh_path(spark, "report")
    lines = i.table(spark, sf_dir, "lineitem")
    suite = QualitySuite([row_count(1, 5_000_000_000_000), null_percentage("l_shipdate", 0.0)])
    results = suite.evaluate(lines).select("rule", "status", "observed_num")
    for run in ("run-1", "run-2", "run-2"):
        writers.write_report(results, path, run)
    return readers.read_parquet(spark, path).select("run_id", "rule", "status", "observed_num")


def profile_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of a profile stored for two runs, the second one written twice; rows per section and run."""
    path = fresh_path(spark, "profile")
    lines = i.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_tax", "l_discount", "l_shipdate")
    spec = ProfileSpec(numeric=("l_tax", "l_discount"), categorical=("l_returnflag",), dates=("l_shipdate",))
    sections = profile(lines, spec)
    for run in ("run-1", "run-2", "run-2"):
        writers.write_sections(sections, path, run)
    found = None
    for name in sections:
        rows = readers.read_parquet(spark, f"{path}/{name}").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
        rows = rows.select(F.lit(name).alias("section"), "run_id", "n_rows")
        found = rows if found is None else found.unionByName(rows)
    return found


def _upserted(spark: SparkSession, sf_dir: str) -> KeyedTable:
    before, after = i.snapshots(spark, sf_dir)
    table = KeyedTable(spark, fresh_path(spark, "keyed"), ["c_custkey"])
    table.upsert(before)
    table.upsert(after)
    return table


def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).read()


def feature_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table after its earlier versions and their files were dropped."""
    table = _upserted(spark, sf_dir)
    table.drop_before(table.versions()[-1])
    return table.read()


def feature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second upsert changed."""
    changes = _upserted(spark, sf_dir).changes(starting_version=1)
    return changes.select("c_custkey", "c_acctbal", "_change_type", "_commit_version").withColumnsRenamed(
        {"_change_type": "change_type", "_commit_version": "commit_version"}
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = i.snapshots(spark, sf_dir)
    changes = snapshot_changes(before, after, ["c_custkey"], version=1)
    return changes.select("c_custkey", "c_acctbal", F.col("_change_type").alias("change_type"))


QUERIES = {
    f.__name__: f
    for f in (
        src_table,
        src_parquet,
        src_csv_roundtrip,
        src_json_roundtrip,
        sink_table_roundtrip,
        sink_partitioned,
        sink_append,
        report_sink_roundtrip,
        profile_sink_roundtrip,
        feature_upsert,
        feature_compaction,
        feature_changes,
        change_feed,
    )
}

_UPSERT = """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM snapshot_after
UNION ALL
SELECT b.c_custkey, b.c_name, b.c_acctbal, b.c_mktsegment FROM snapshot_before b
WHERE NOT EXISTS (SELECT 1 FROM snapshot_after a WHERE a.c_custkey = b.c_custkey)
"""

_DIFFERS = """a.c_name IS DISTINCT FROM b.c_name OR a.c_acctbal IS DISTINCT FROM b.c_acctbal
   OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment"""

_CHANGES = f"""
SELECT a.c_custkey, a.c_acctbal, CASE WHEN b.c_custkey IS NULL THEN 'insert' ELSE 'update_postimage' END AS change_type
FROM snapshot_after a LEFT JOIN snapshot_before b ON a.c_custkey = b.c_custkey
WHERE b.c_custkey IS NULL OR {_DIFFERS}
UNION ALL
SELECT b.c_custkey, b.c_acctbal, CASE WHEN a.c_custkey IS NULL THEN 'delete' ELSE 'update_preimage' END AS change_type
FROM snapshot_before b LEFT JOIN snapshot_after a ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR {_DIFFERS}
"""

_REPORT = """
SELECT r.run_id, v.rule, v.status, v.observed_num
FROM (SELECT 'run-1' AS run_id UNION ALL SELECT 'run-2') r,
(SELECT 'row_count' AS rule, 'pass' AS status, CAST(COUNT(*) AS DOUBLE) AS observed_num FROM lineitem
 UNION ALL SELECT 'null_percentage[l_shipdate]', CASE WHEN COUNT(*) = COUNT(l_shipdate) THEN 'pass' ELSE 'fail' END,
   ROUND(CAST(COUNT(*) - COUNT(l_shipdate) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) FROM lineitem) v
"""

ORACLES = {
    "src_table": "SELECT o_orderstatus, COUNT(*) AS n_orders, "
    "ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total_price FROM orders GROUP BY o_orderstatus",
    "src_parquet": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n_lines FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "src_csv_roundtrip": "SELECT * FROM customer",
    "src_json_roundtrip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "STRFTIME(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders",
    "sink_table_roundtrip": "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part",
    "sink_partitioned": "SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
    "sink_append": "SELECT o_orderstatus, CAST(2 * COUNT(*) AS BIGINT) AS n_orders FROM orders GROUP BY o_orderstatus",
    "report_sink_roundtrip": _REPORT,
    "profile_sink_roundtrip": """
SELECT section, run_id, n_rows FROM (VALUES ('run-1'), ('run-2')) r(run_id), (
  SELECT 'schema' AS section, CAST(4 AS BIGINT) AS n_rows UNION ALL SELECT 'nulls', 4 UNION ALL SELECT 'duplicates', 1
  UNION ALL SELECT 'numeric', 2 UNION ALL SELECT 'correlations', 1 UNION ALL SELECT 'outliers', 2
  UNION ALL SELECT 'categorical', (SELECT COUNT(DISTINCT l_returnflag) FROM lineitem)
  UNION ALL SELECT 'temporal', (SELECT COUNT(DISTINCT STRFTIME(l_shipdate, '%Y-%m')) FROM lineitem)) s
""",
    "feature_upsert": over("snapshot_before snapshot_after", _UPSERT),
    "feature_compaction": over("snapshot_before snapshot_after", _UPSERT),
    "feature_changes": over(
        "snapshot_before snapshot_after",
        f"SELECT *, CAST(1 AS BIGINT) AS commit_version FROM ({_CHANGES}) c WHERE change_type <> 'delete'",
    ),
    "change_feed": over("snapshot_before snapshot_after", _CHANGES),
}
