"""Streaming queries, run over all that has arrived and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import rules as r
from gaugeworks.operators.features import customer_features, prepare_datasets
from gaugeworks.operators.learning import load_model, save_model, train
from gaugeworks.operators.scoring import Provenance
from gaugeworks.plans import inputs as i
from gaugeworks.plans.features import RUN_TIME, SPEC
from gaugeworks.plans.models import LOGISTIC
from gaugeworks.sources.keyed import FeatureStore, KeyedTable
from gaugeworks.streaming import features as sf
from gaugeworks.streaming import sources as ss
from gaugeworks.streaming import windows as sw
from gaugeworks.workspace import fresh_path

DELAY = "1 hour"


def _rules():
    return (
        r.row_count(1, 20),
        r.null_percentage("props", 0.05),
        r.value_range("value", 0.0, 150.0),
        r.allowed_domain("event_type", ("view", "click", "purchase")),
    )


class _Closing:
    """Events followed, in a second run, by one row far in the future.

    The late-dated row moves the watermark past the last real window, so that
    append mode emits every window with real rows. Its own window stays open.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, label: str):
        self.spark = spark
        self.folder = fresh_path(spark, label)
        self.events = i.table(spark, sf_dir, "events")
        self.path = f"{sf_dir}/events.parquet"
        # An empty folder a stream can start on.
        self._put(self.events.limit(0))

    def _put(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/closing")

    def stream(self) -> DataFrame:
        schema = self.events.schema
        arriving = ss.read_stream(self.spark, self.path, schema)
        both = arriving.unionByName(ss.read_stream(self.spark, f"{self.folder}/closing", schema))
        return ss.with_event_time(both, "ts", DELAY)

    def collect(self, build) -> DataFrame:
        """Run over the events, then over the closing row from the checkpoint of the first run."""
        out, checkpoint = f"{self.folder}/out", f"{self.folder}/checkpoint"
        ss.to_files(build(self.stream()), out, checkpoint)
        future = self.events.agg(F.max("ts").alias("ts")).select(
            *[
                (F.col("ts") + F.expr("INTERVAL 365 DAYS") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in self.events.schema.fields
            ]
        )
        self._put(future)
        ss.to_files(build(self.stream()), out, checkpoint)
        return self.spark.read.parquet(out)


def _text(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def stream_quality_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    closing = _Closing(spark, sf_dir, "quality")
    rows = closing.collect(lambda s: sw.windowed_rules(s, _rules(), "ts", "1 hour"))
    return rows.select(_text("window_start"), "rule", "status", F.col("observed_num").alias("observed"))


def stream_duplicates_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on keys per window: users who come twice, kinds of events, and events of customers that exist."""
    customers = i.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    listed = spark.createDataFrame([("view",), ("click",), ("purchase",)], "kind string")
    rules = (
        r.row_count(1, 20),
        r.duplicates(["user_id"], 0.01),
        r.duplicates(["user_id", "event_type"], 0.0),
        r.cardinality("event_type", 4),
        r.allowed_domain_table("event_type", listed, "kind"),
        r.referential_integrity("user_id", customers, "c_custkey"),
    )
    rows = _Closing(spark, sf_dir, "keys").collect(lambda s: sw.windowed_rules(s, rules, "ts", "1 hour"))
    return rows.select(_text("window_start"), "rule", "status", F.col("observed_num").alias("observed"))


def stream_prediction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase counts as a positive prediction, an error as a missing one."""
    kind = F.col("event_type")
    prediction = F.when(kind == "purchase", 1.0).when(kind != "error", 0.0)
    closing = _Closing(spark, sf_dir, "predictions")
    rows = closing.collect(
        lambda s: sw.windowed_predictions(s.withColumn("prediction", prediction), "ts", "2 hours", "1 hour")
    )
    return rows.select(_text("window_start"), "row_count", "positive_rate", "error_rate")


def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the customer of every arriving order from a stored feature table."""
    training, _, _ = prepare_datasets(
        i.churn(spark, sf_dir), key="customer_id", numeric=i.NUMERIC, categorical=i.CATEGORICAL, label="churn"
    )
    folder = fresh_path(spark, "scoring")
    save_model(train(training, LOGISTIC), f"{folder}/model")
    store = FeatureStore(spark, f"{folder}/features")
    store.write(customer_features(i.churn(spark, sf_dir), F.lit(RUN_TIME).cast("timestamp")), SPEC)
    orders = ss.read_stream(spark, f"{sf_dir}/orders.parquet", i.table(spark, sf_dir, "orders").schema)
    keys = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("customer_id"))
    scores = sf.scored_stream(
        keys,
        store.read(SPEC),
        SPEC,
        load_model(f"{folder}/model"),
        i.NUMERIC,
        i.CATEGORICAL,
        Provenance("champion", F.lit(RUN_TIME).cast("timestamp"), "1"),
    )
    ss.to_files(scores, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select(
        "o_orderkey",
        "customer_id",
        "tenure_months",
        "model_version",
        F.col("probability_churn").between(0.0, 1.0).alias("has_probability"),
    )


def stream_feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event per user, kept up to date by two arrivals of events."""
    folder = fresh_path(spark, "upsert")
    events = i.table(spark, sf_dir, "events")
    table = KeyedTable(spark, f"{folder}/table", ["user_id"])
    order = F.struct("ts", "event_id")

    def latest(batch: DataFrame) -> DataFrame:
        return batch.groupBy("user_id").agg(
            F.max("ts").alias("ts"), F.max_by("event_id", order).alias("event_id"), F.max_by("value", order).alias("value")
        )

    middle = events.agg(F.percentile_approx("ts", 0.5)).scalar()
    for arrived in (F.col("ts") < middle, F.col("ts") >= middle):
        events.where(arrived).write.mode("append").parquet(f"{folder}/landing")
        stream = ss.read_stream(spark, f"{folder}/landing", events.schema)
        sf.upsert_stream(stream, table, f"{folder}/checkpoint", "events", latest)
    return table.read().select("user_id", "event_id", F.round("value", 6).alias("value"))


def stream_incremental_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a landing folder: the second one reads only what is new."""
    folder = fresh_path(spark, "incremental")
    events = i.table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    for arrived in (error, ~error):
        events.where(arrived).write.mode("append").parquet(f"{folder}/landing")
        stream = ss.read_stream(spark, f"{folder}/landing", events.schema, max_files_per_batch=4)
        ss.to_files(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 2).alias("total")
    )


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice leave the stream once."""
    events = i.table(spark, sf_dir, "events")
    folder = fresh_path(spark, "dedup")
    path = f"{sf_dir}/events.parquet"
    twice = ss.read_stream(spark, path, events.schema).unionByName(ss.read_stream(spark, path, events.schema))
    unique = sw.deduplicated(ss.with_event_time(twice, "ts", DELAY), ["event_id"])
    ss.to_files(unique, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


QUERIES = {
    fn.__name__: fn
    for fn in (
        stream_quality_hourly,
        stream_duplicates_hourly,
        stream_prediction_rate,
        stream_scoring,
        stream_feature_upsert,
        stream_incremental_read,
        stream_dedup,
    )
}

_HOURLY = """
SELECT STRFTIME(h, '%Y-%m-%d %H:%M:%S') AS window_start, rule,
  CASE WHEN passed THEN 'pass' ELSE 'fail' END AS status, ROUND(CAST(x AS DOUBLE), 4) AS observed
FROM (
  SELECT h, 'row_count' AS rule, n AS x, n BETWEEN 1 AND 20 AS passed FROM w
  UNION ALL SELECT h, 'null_percentage[props]', CAST(nulls AS DOUBLE) / CAST(n AS DOUBLE), CAST(nulls AS DOUBLE) / CAST(n AS DOUBLE) <= 0.05 FROM w
  UNION ALL SELECT h, 'value_range[value]', far, far = 0 FROM w
  UNION ALL SELECT h, 'allowed_domain[event_type]', off, off = 0 FROM w) v
"""

_WINDOWS = """
SELECT DATE_TRUNC('hour', ts) AS h, COUNT(*) AS n, COUNT(*) - COUNT(props) AS nulls,
  COUNT(*) FILTER (WHERE value < 0 OR value > 150) AS far,
  COUNT(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')) AS off
FROM events GROUP BY 1
"""

_KEYED = """
WITH e AS (SELECT DATE_TRUNC('hour', ts) AS h, *, CASE WHEN c_custkey IS NULL THEN user_id END AS orphan
  FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) c ON user_id = c_custkey),
w AS (SELECT h, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT user_id || ':' || event_type) AS pairs,
  COUNT(DISTINCT event_type) AS kinds, COUNT(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')) AS off,
  COUNT(DISTINCT orphan) AS orphans FROM e GROUP BY h),
v AS (SELECT h, 'row_count' AS rule, CAST(n AS DOUBLE) AS x, n BETWEEN 1 AND 20 AS passed FROM w
  UNION ALL SELECT h, 'duplicates[user_id]', CAST(n - users AS DOUBLE) / n, CAST(n - users AS DOUBLE) / n <= 0.01 FROM w
  UNION ALL SELECT h, 'duplicates[user_id,event_type]', CAST(n - pairs AS DOUBLE) / n, n = pairs FROM w
  UNION ALL SELECT h, 'cardinality[event_type]', kinds, kinds <= 4 FROM w
  UNION ALL SELECT h, 'allowed_domain[event_type]', off, off = 0 FROM w
  UNION ALL SELECT h, 'referential_integrity[user_id]', orphans, orphans = 0 FROM w)
SELECT STRFTIME(h, '%Y-%m-%d %H:%M:%S') AS window_start, rule, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS status,
  ROUND(CAST(x AS DOUBLE), 4) AS observed FROM v
"""

_SLIDING = """
SELECT STRFTIME(h, '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS row_count,
  ROUND(CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) AS positive_rate,
  ROUND(CAST(COUNT(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 4) AS error_rate
FROM (SELECT DATE_TRUNC('hour', ts) AS h, event_type FROM events
      UNION ALL SELECT DATE_TRUNC('hour', ts) - INTERVAL 1 HOUR, event_type FROM events) e GROUP BY h
"""

_LATEST = """
SELECT user_id, event_id, ROUND(value, 6) AS value FROM (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1
"""

ORACLES = {
    "stream_quality_hourly": f"WITH w AS ({_WINDOWS}) {_HOURLY}",
    "stream_duplicates_hourly": _KEYED,
    "stream_prediction_rate": _SLIDING,
    "stream_scoring": (
        "WITH history AS (SELECT o_custkey, CAST((YEAR(MAX(o_orderdate)) - YEAR(MIN(o_orderdate))) * 12 "
        "+ MONTH(MAX(o_orderdate)) - MONTH(MIN(o_orderdate)) AS INT) AS tenure_months FROM orders GROUP BY o_custkey) "
        "SELECT o.o_orderkey, CAST(o.o_custkey AS VARCHAR) AS customer_id, "
        "CASE WHEN c.c_custkey IS NOT NULL THEN h.tenure_months END AS tenure_months, "
        "'1' AS model_version, TRUE AS has_probability FROM orders o JOIN history h ON o.o_custkey = h.o_custkey "
        "LEFT JOIN customer c ON o.o_custkey = c.c_custkey"
    ),
    "stream_feature_upsert": _LATEST,
    "stream_incremental_read": "SELECT event_type, COUNT(*) AS n_events, "
    "ROUND(CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM events GROUP BY event_type",
    "stream_dedup": "SELECT event_id, user_id, event_type FROM events",
}
