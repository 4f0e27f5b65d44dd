"""Feature, split and lookup queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import features as f
from gaugeworks.operators.learning import category_dictionary, feature_stages, with_indexes
from gaugeworks.plans import inputs as i
from gaugeworks.plans.sql import over
from gaugeworks.sources.keyed import FeatureStore
from gaugeworks.workspace import fresh_path

RUN_TIME = "2024-01-01 00:00:00"
SPEC = f.FeatureSpec(
    table="churn.features",
    keys=("customer_id",),
    features=(
        *i.NUMERIC,
        *i.CATEGORICAL,
        "avg_monthly_charge_ratio",
        "support_calls_per_tenure_month",
    ),
)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.customer_features(i.churn(spark, sf_dir), F.lit(RUN_TIME).cast("timestamp"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per order: customers repeat, and customers without features occur."""
    orders = i.table(spark, sf_dir, "orders")
    return orders.select(
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("new-"), F.col("o_custkey")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("customer_id"),
        F.when(F.col("o_totalprice") > 100_000, 1).otherwise(0).alias("large_order"),
    )


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.customer_features(i.churn_dirty(spark, sf_dir), F.lit(RUN_TIME).cast("timestamp"))
    return rows.select(
        "customer_id",
        "tenure_months",
        # Cents over up to 64 months end within eight digits, so no value lies half way between two.
        F.round("avg_monthly_charge_ratio", 8).alias("avg_monthly_charge_ratio"),
        F.round("support_calls_per_tenure_month", 8).alias("support_calls_per_tenure_month"),
        F.date_format("feature_timestamp", "yyyy-MM-dd").alias("feature_day"),
    )


def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = f.impute(i.churn_dirty(spark, sf_dir), [*i.NUMERIC, "no_such_column"], i.CATEGORICAL)
    return f.label_as_double(filled, "churn").select("customer_id", *i.NUMERIC, *i.CATEGORICAL, "churn")


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.training_set(_labels(spark, sf_dir), _features(spark, sf_dir), SPEC, "large_order")
    return rows.select("customer_id", "large_order", "contract_type", F.round("total_charges", 2).alias("total_charges"))


def training_set_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with bigint keys, two of which have most rows, and features with int keys; hot keys are spread."""
    orders = i.table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderstatus") == "O", F.lit(1)).when(F.col("o_orderstatus") == "F", F.lit(2)).otherwise(F.col("o_custkey"))
    labels = orders.select(key.cast("bigint").alias("customer"), F.col("o_orderkey").alias("label"))
    customers = i.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("customer"), "c_nationkey")
    spec = f.FeatureSpec(table="churn.nations", keys=("customer",), features=("c_nationkey",))
    return f.training_set(labels, customers, spec, "label", hot_share=0.1)


def training_set_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a collation holds for equal, in other letters on the two sides; hot keys are spread."""
    priority = "if(o_orderkey % 2 = 0, upper(o_orderpriority), lower(o_orderpriority))"
    labels = i.table(spark, sf_dir, "orders").selectExpr(f"{priority} COLLATE UTF8_LCASE AS priority", "o_orderkey AS label")
    named = [("1-Urgent", 1), ("2-High", 2), ("3-Medium", 3), ("5-Low", 5)]
    levels = spark.createDataFrame(named, "priority string, level int").selectExpr("priority COLLATE UTF8_LCASE AS priority", "level")
    spec = f.FeatureSpec(table="churn.levels", keys=("priority",), features=("level",))
    joined = f.training_set(labels, levels, spec, "label", hot_share=0.05)
    return joined.select(F.expr("lower(string(priority)) COLLATE UTF8_BINARY").alias("priority"), "label", "level")


def category_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of columns with many categories by dictionary, learned from part of the lines and applied to all."""
    lines = i.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "string(l_partkey) AS part", "if(l_linenumber = 4, NULL, l_returnflag) AS flag"
    )
    dictionary = category_dictionary(lines.where("l_orderkey % 3 <> 0"), ["part", "flag"])
    return with_indexes(lines, dictionary, ["part", "flag"])


def training_set_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a feature table that was written twice."""
    store = FeatureStore(spark, fresh_path(spark, "store"))
    for _ in range(2):
        store.write(_features(spark, sf_dir), SPEC)
    rows = store.training_set(_labels(spark, sf_dir), SPEC, "large_order")
    return rows.select("customer_id", "large_order", "contract_type", F.round("total_charges", 2).alias("total_charges"))


def training_set_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of two feature tables, one of them written twice, and of a training set, next to its size."""
    store = FeatureStore(spark, fresh_path(spark, "store"))
    other = f.FeatureSpec(table="churn.nations", keys=("c_custkey",), features=("c_nationkey",), timestamp="updated")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    for day in (1, 2):
        store.write(_features(spark, sf_dir), SPEC, at(day))
    store.write(i.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), other, at(3))
    labels = _labels(spark, sf_dir)
    parts = [
        store.provenance(spec, label).withColumn("n_rows", size.scalar())
        for spec, label, size in (
            (SPEC, "large_order", store.training_set(labels, SPEC, "large_order").agg(F.count(F.lit(1)))),
            (other, "c_nationkey", store.read(other).agg(F.count(F.lit(1)))),
        )
    ]
    return parts[0].unionByName(parts[1]).select(
        "table_name", F.array_join("lookup_keys", ",").alias("lookup_keys"), F.array_join("feature_names", ",").alias("feature_names"),
        "timestamp_column", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), "label",
        F.col("table_version").cast("bigint").alias("table_version"), "n_rows",
    )


def unmatched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.unmatched_labels(_labels(spark, sf_dir), _features(spark, sf_dir), SPEC)


def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _labels(spark, sf_dir).select("customer_id")
    return f.feature_lookup(keys, _features(spark, sf_dir), SPEC).select(
        "customer_id", "contract_type", "tenure_months", F.round("total_charges", 2).alias("total_charges")
    )


def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = f.split_column(F.col("customer_id"), 0.7, 0.15, 0.15, 42)
    return i.churn(spark, sf_dir).select("customer_id", split.alias("split"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = f.split_column(F.col("customer_id"), 0.7, 0.15, 0.15, 42)
    return i.churn(spark, sf_dir).groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("churn").alias("positives")
    )


def prepare_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, label sum and remaining NULLs per split."""
    parts = f.prepare_datasets(
        i.churn(spark, sf_dir), key="customer_id", numeric=i.NUMERIC, categorical=i.CATEGORICAL, label="churn"
    )
    result = None
    for name, part in zip(f.SPLITS, parts):
        row = part.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("churn").alias("label_sum"),
            F.count_if(F.col("total_charges").isNull()).alias("null_charges"),
        ).withColumn("split", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result


def _staged(spark: SparkSession, sf_dir: str, numeric, categorical) -> DataFrame:
    """The imputed rows after the library's feature stages for some columns."""
    churn = f.impute(i.churn(spark, sf_dir), i.NUMERIC, i.CATEGORICAL)
    return Pipeline(stages=feature_stages(numeric, categorical)).fit(churn).transform(churn)


def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _staged(spark, sf_dir, [], ["contract_type"])
    return staged.select("contract_type", F.col("contract_type_index").alias("idx")).distinct()


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _staged(spark, sf_dir, [], ["contract_type"])
    return staged.select("customer_id", vector_to_array("contract_type_encoded").alias("v")).select(
        "customer_id", *[F.col("v")[k].alias(f"slot_{k}") for k in range(3)]
    )


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _staged(spark, sf_dir, i.NUMERIC, [])
    return staged.select("customer_id", vector_to_array("features").alias("v")).select(
        "customer_id", *[F.round(F.col("v")[k], 6).alias(c) for k, c in enumerate(i.NUMERIC)]
    )


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages together: length of the vectors and how many hold a NaN."""
    churn = f.impute(i.churn_dirty(spark, sf_dir), i.NUMERIC, i.CATEGORICAL)
    model = Pipeline(stages=feature_stages(i.NUMERIC, i.CATEGORICAL)).fit(churn)
    values = vector_to_array("features")
    return model.transform(churn).groupBy(F.size(values).alias("n_slots")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.exists(values, F.isnan)).alias("n_with_nan")
    )


QUERIES = {
    fn.__name__: fn
    for fn in (
        customer_features,
        impute,
        training_set,
        training_set_mixed_types,
        training_set_collated,
        category_indexes,
        training_set_stored,
        training_set_provenance,
        unmatched_labels,
        feature_lookup,
        split_assign,
        split_counts,
        prepare_datasets,
        string_index,
        one_hot,
        standard_scale,
    )
}
QUERIES["feature_stages"] = feature_vectors

_LABELS = """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'new-' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
  CAST(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS INT) AS large_order FROM orders
"""

_TRAINING = """
SELECT l.customer_id, l.large_order, c.contract_type, ROUND(c.total_charges, 2) AS total_charges
FROM order_labels l JOIN churn c ON l.customer_id = c.customer_id
"""

_INDEX = """
SELECT contract_type, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, contract_type ASC) - 1 AS DOUBLE) AS idx
FROM churn GROUP BY contract_type
"""


def _slot(k: int) -> str:
    return f"CAST(CASE WHEN x.idx = {k} THEN 1 ELSE 0 END AS DOUBLE) AS slot_{k}"


def _scaled(c: str) -> str:
    return f"ROUND((COALESCE(CAST({c} AS DOUBLE), 0) - s.m_{c}) / s.d_{c}, 6) AS {c}"


def _moments(c: str) -> str:
    x = f"COALESCE(CAST({c} AS DOUBLE), 0)"
    return f"AVG({x}) AS m_{c}, STDDEV_SAMP({x}) AS d_{c}"


ORACLES = {
    "customer_features": over(
        "churn_dirty",
        "SELECT customer_id, tenure_months, ROUND(CASE WHEN tenure_months > 0 "
        "THEN total_charges / CAST(tenure_months AS DOUBLE) ELSE monthly_charges END, 8) AS avg_monthly_charge_ratio, "
        "ROUND(CAST(support_calls AS DOUBLE) / CAST(tenure_months + 1 AS DOUBLE), 8) AS support_calls_per_tenure_month, "
        "'2024-01-01' AS feature_day FROM churn_dirty",
    ),
    "impute": over(
        "churn_dirty",
        "SELECT customer_id, COALESCE(tenure_months, 0) AS tenure_months, COALESCE(monthly_charges, 0) AS monthly_charges, "
        "COALESCE(total_charges, 0) AS total_charges, COALESCE(contract_type, 'unknown') AS contract_type, "
        "COALESCE(internet_service, 'unknown') AS internet_service, COALESCE(support_calls, 0) AS support_calls, "
        "CAST(churn AS DOUBLE) AS churn FROM churn_dirty",
    ),
    "training_set": over("churn", _TRAINING, order_labels=_LABELS),
    "training_set_collated": "SELECT LOWER(o_orderpriority) AS priority, o_orderkey AS label, CAST(level AS INT) AS level FROM orders "
    "JOIN (VALUES ('1-urgent', 1), ('2-high', 2), ('3-medium', 3), ('5-low', 5)) v(name, level) ON LOWER(o_orderpriority) = name",
    "category_indexes": """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS part, CASE WHEN l_linenumber <> 4 THEN l_returnflag END AS flag FROM lineitem),
p AS (SELECT part, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, part) - 1 AS DOUBLE) AS k FROM l WHERE l_orderkey % 3 <> 0 GROUP BY part),
f AS (SELECT flag, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, flag) - 1 AS DOUBLE) AS k FROM l WHERE l_orderkey % 3 <> 0 AND flag IS NOT NULL GROUP BY flag)
SELECT l.l_orderkey, l.l_linenumber, l.part, l.flag, COALESCE(p.k, (SELECT CAST(COUNT(*) AS DOUBLE) FROM p)) AS part_index,
  COALESCE(f.k, (SELECT CAST(COUNT(*) AS DOUBLE) FROM f)) AS flag_index
FROM l LEFT JOIN p ON l.part = p.part LEFT JOIN f ON l.flag = f.flag
""",
    "training_set_mixed_types": "SELECT k AS customer, o_orderkey AS label, c_nationkey FROM (SELECT CAST(CASE o_orderstatus "
    "WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE o_custkey END AS BIGINT) AS k, o_orderkey FROM orders) o JOIN customer ON c_custkey = k",
    "training_set_stored": over("churn", _TRAINING, order_labels=_LABELS),
    "training_set_provenance": over(
        "churn",
        f"SELECT 'churn.features' AS table_name, 'customer_id' AS lookup_keys, '{','.join(SPEC.features)}' AS feature_names, "
        "'feature_timestamp' AS timestamp_column, '2024-01-02' AS updated, 'large_order' AS label, CAST(1 AS BIGINT) AS table_version, "
        "COUNT(*) AS n_rows FROM order_labels JOIN churn USING (customer_id) UNION ALL "
        "SELECT 'churn.nations', 'c_custkey', 'c_nationkey', 'updated', '2024-01-03', 'c_nationkey', CAST(0 AS BIGINT), COUNT(*) FROM customer",
        order_labels=_LABELS,
    ),
    "unmatched_labels": over(
        "churn",
        "SELECT COUNT(*) AS n_unmatched, COUNT(DISTINCT customer_id) AS n_unmatched_keys FROM order_labels l "
        "WHERE NOT EXISTS (SELECT 1 FROM churn c WHERE c.customer_id = l.customer_id)",
        order_labels=_LABELS,
    ),
    "feature_lookup": over(
        "churn",
        "SELECT l.customer_id, c.contract_type, c.tenure_months, ROUND(c.total_charges, 2) AS total_charges "
        "FROM order_labels l LEFT JOIN churn c ON l.customer_id = c.customer_id",
        order_labels=_LABELS,
    ),
    "split_assign": over("splits", "SELECT customer_id, split FROM splits"),
    "split_counts": over(
        "splits", "SELECT split, COUNT(*) AS n, CAST(SUM(churn) AS BIGINT) AS positives FROM splits GROUP BY split"
    ),
    "prepare_datasets": over(
        "splits",
        "SELECT split, COUNT(*) AS n, CAST(SUM(churn) AS DOUBLE) AS label_sum, CAST(0 AS BIGINT) AS null_charges "
        "FROM splits GROUP BY split",
    ),
    "string_index": over("churn", _INDEX),
    "one_hot": over(
        "churn",
        f"SELECT c.customer_id, {_slot(0)}, {_slot(1)}, {_slot(2)} FROM churn c JOIN indexed x USING (contract_type)",
        indexed=_INDEX,
    ),
    "standard_scale": over(
        "churn",
        f"SELECT customer_id, {', '.join(_scaled(c) for c in i.NUMERIC)} FROM churn, moments s",
        moments=f"SELECT {', '.join(_moments(c) for c in i.NUMERIC)} FROM churn",
    ),
    # Three contract types plus 'weekly' and 'unknown', three services; all kept slots but the extra ones.
    "feature_stages": over(
        "churn_dirty",
        "SELECT CAST(4 + COUNT(DISTINCT COALESCE(contract_type, 'unknown')) "
        "+ COUNT(DISTINCT COALESCE(internet_service, 'unknown')) AS INT) AS n_slots, "
        "COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_with_nan FROM churn_dirty",
    ),
}
