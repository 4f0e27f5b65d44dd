"""Gate, promotion, alias and registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gaugeworks.operators import promotion as p
from gaugeworks.operators import registry as g
from gaugeworks.plans import inputs as i
from gaugeworks.plans.sql import over

MINIMA = dict.fromkeys(p.METRICS, 0.5)
POLICY = p.PromotionPolicy(MINIMA)
CENTRAL = p.PromotionPolicy({"accuracy": 0.5, "precision": 0.5, "roc_auc": 0.5}, missing="skip")
METRICS_ONLY = ("accuracy", "precision", "recall", "f1_score", "roc_auc")


def _role() -> F.Column:
    version = F.col("model_version")
    return F.when(version == "A", F.lit("champion")).when(version == "R", F.lit("challenger"))


def metric_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some reports lack the recall, some the share of invalid predictions."""
    m = F.col("model_id")
    reports = i.model_metrics(spark, sf_dir).withColumns(
        {
            "recall": F.when(m % 6 != 0, F.col("recall")),
            "invalid_share": F.when(m % 4 != 0, (m % 5).cast("double") / F.lit(200.0)),
        }
    )
    gated = p.metric_gate(reports, MINIMA, "invalid_share")
    return gated.select("model_id", "model_version", F.array_join("failures", ",").alias("failures"), "passed")


def _decision(rows: DataFrame) -> DataFrame:
    return rows.select(
        "model_id",
        F.round("champion_metric", 6).alias("champion_metric"),
        F.round("challenger_metric", 6).alias("challenger_metric"),
        "is_first_model",
        "absolute_improvement",
        "relative_improvement",
        "regression_within_limit",
        "recommendation",
    )


def promotion_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = p.pair_roles(i.model_metrics(spark, sf_dir), "model_id", _role())
    return _decision(p.recommend(pairs, POLICY))


def promotion_recommendation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decision from a table of challengers and a table of champions."""
    metrics = i.model_metrics(spark, sf_dir)
    pairs = p.pair_tables(metrics.where("model_version = 'R'"), metrics.where("model_version = 'A'"), "model_id")
    return _decision(p.recommend(pairs, POLICY))


def promotion_recommendation_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics a challenger does not report are skipped; without any it is rejected."""
    m = F.col("model_id")
    metrics = i.model_metrics(spark, sf_dir).withColumns(
        {
            "roc_auc": F.when(m % 4 != 0, F.col("roc_auc")),
            "accuracy": F.when(m % 8 != 0, F.col("accuracy")),
            "precision": F.when(m % 8 != 0, F.col("precision")),
        }
    )
    pairs = p.pair_roles(metrics, "model_id", _role())
    return p.recommend(pairs, CENTRAL).select(
        "model_id", F.array_join("absolute_failures", ",").alias("failures"), "absolute_approval", "recommendation"
    )


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = p.pair_roles(i.model_metrics(spark, sf_dir), "model_id", _role())
    return p.recommend(pairs, POLICY)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = i.promotion_inputs(spark, sf_dir)
    recommendations = _recommended(spark, sf_dir).join(records, "model_id").select(
        "model_id",
        "recommendation",
        "technical_approval",
        F.col("rec_version").alias("version"),
        F.col("rec_run_id").alias("run_id"),
        F.col("rec_commit").alias("commit"),
    )
    runs = records.select(
        "model_id", F.col("run_version").alias("version"), F.col("run_run_id").alias("run_id"), F.col("run_commit").alias("commit")
    )
    approvals = records.select(
        "model_id", "approver", F.col("approval_version").alias("version"), F.col("approval_run_id").alias("run_id")
    )
    return p.promotion_metadata_check(recommendations, runs, approvals, "model_id")


def promotion_metadata_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("model_id", F.array_join("problems", ",").alias("problems"), "consistent")


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts stand for artifacts; some were changed after they were validated."""
    docs = i.table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    validated = docs.select(
        "doc_id",
        F.when(number % 3 == 0, F.lit("c0ffee")).otherwise(F.lit("deadbe")).alias("git_commit"),
        F.col("lang").alias("model_version"),
        F.sha2("text", 256).alias("sha256"),
    )
    arrived = F.when(number % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    delivered = docs.select(
        "doc_id",
        F.when(number % 6 == 0, F.lit("c0ffee")).otherwise(F.lit("deadbe")).alias("git_commit"),
        F.col("lang").alias("model_version"),
        F.sha2(arrived, 256).alias("sha256"),
    )
    return p.manifest_check(validated, delivered, "doc_id").select(
        "doc_id", F.array_join("mismatches", ",").alias("mismatches"), "intact"
    )


def alias_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.alias_state(i.alias_events(spark, sf_dir))


def alias_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.alias_history(i.alias_events(spark, sf_dir)).select(
        "model_id", "event_id", "action", "version", "previous_version"
    )


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions count as runs to register, on top of versions that exist already."""
    events = i.alias_events(spark, sf_dir)
    runs = events.where("action = 'promote'").select("model_id", "ts", "event_id")
    return g.register_versions(runs, events.where("action = 'register'")).select("model_id", "event_id", "version")


def promotion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promote the challenger of every model whose metadata is consistent, if it has events."""
    state = g.alias_state(i.alias_events(spark, sf_dir))
    checked = _checked(spark, sf_dir).select("model_id", "consistent")
    candidates = state.select("model_id", F.col("challenger_version").alias("version")).join(checked, "model_id")
    return g.promotion_plan(candidates, state)


def _rollback_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = i.alias_events(spark, sf_dir)
    versions = (
        events.where("action = 'register'")
        .groupBy("model_id", "version")
        .agg(F.concat(F.lit("run-"), F.min("event_id").cast("string")).alias("run_id"))
    )
    requests = (
        events.where("action = 'rollback'")
        .groupBy("model_id")
        .agg(F.max_by("version", F.struct("ts", "event_id")).alias("target_version"))
        .select("model_id", "target_version", F.lit("ops").alias("author"), F.lit("recall fell").alias("reason"), F.lit("b1").alias("build_id"))
    )
    return requests, versions, g.alias_state(events)


def rollback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, versions, state = _rollback_inputs(spark, sf_dir)
    return g.rollback_plan(requests, versions, state).select(
        "model_id", "from_version", "to_version", "to_run_id", "will_set_previous_champion_to", "dry_run", "status"
    )


def rollback_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed, with a smoke check that fails for every third model: alias state afterwards."""
    requests, versions, state = _rollback_inputs(spark, sf_dir)
    smoke = versions.select("model_id", "version", (F.col("model_id") % 3 != 0).alias("smoke_test_passed"))
    plan = g.rollback_plan(requests, versions, state, confirm=True, smoke=smoke)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    events = i.alias_events(spark, sf_dir)
    return g.alias_state(events.unionByName(g.rollback_events(plan, now)))


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Params, metrics and tags of one run per metrics row, as maps and back to rows."""
    m, v = F.col("model_id"), F.col("model_version")
    runs = g.run_table(
        i.model_metrics(spark, sf_dir),
        F.concat_ws("-", m, v),
        {"algorithm": F.lit("logistic_regression"), "hp_max_iter": F.lit(50)},
        METRICS_ONLY,
        {"model_name": F.concat(F.lit("model-"), m), "model_alias": F.when(v == "R", F.lit("challenger"))},
    )
    values = g.run_values(runs).withColumn("number", F.round("number", 6))
    return values.where((F.col("section") != "tags") | F.col("text").isNotNull())


def run_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schemas and the example input kept with each run, read back from their JSON."""
    metrics = i.model_metrics(spark, sf_dir)
    runs = g.run_table(metrics, F.concat_ws("-", "model_id", "model_version"), {"algorithm": F.lit("logistic_regression")}, METRICS_ONLY, {})
    inputs = i.churn(spark, sf_dir).select(*i.NUMERIC, *i.CATEGORICAL)
    outputs = StructType([StructField("prediction", DoubleType()), StructField("probability_churn", DoubleType())])
    signed = g.with_signature(runs, inputs.schema, outputs, inputs.orderBy(*inputs.columns))
    names = lambda c: F.array_join(F.from_json(c, "fields array<struct<name:string>>")["fields"]["name"], ",")
    example = F.from_json("input_example", inputs.schema)
    return signed.select(
        "run_id", names("input_signature").alias("inputs"), names("output_signature").alias("outputs"),
        *[example[c].alias(c) for c in ("tenure_months", "monthly_charges")],
    )


QUERIES = {
    fn.__name__: fn
    for fn in (
        metric_gate,
        promotion_recommendation,
        promotion_recommendation_tables,
        promotion_recommendation_central,
        promotion_metadata_check,
        manifest_check,
        alias_state,
        alias_history,
        model_versions,
        promotion_plan,
        rollback_plan,
        rollback_applied,
        run_table,
        run_signature,
    )
}

_COLUMNS = {
    "accuracy": "accuracy",
    "precision": "precision_score",
    "recall": "recall_score",
    "f1_score": "f1_score",
    "roc_auc": "roc_auc",
}

_GATE_INPUT = """
SELECT model_id, model_version, accuracy, precision_score, CASE WHEN model_id % 6 = 0 THEN NULL ELSE recall_score END AS recall_score,
  f1_score, roc_auc, CASE WHEN model_id % 4 = 0 THEN NULL ELSE CAST(model_id % 5 AS DOUBLE) / 200 END AS invalid_share
FROM model_metrics
"""


def _gate_sql() -> str:
    codes = [f"CASE WHEN {c} IS NULL THEN '{name}:missing' END" for name, c in _COLUMNS.items()]
    codes += [f"CASE WHEN {c} < 0.5 THEN '{name}:below_minimum' END" for name, c in _COLUMNS.items()]
    codes.append("CASE WHEN invalid_share > 0.01 THEN 'invalid_predictions:above_maximum' END")
    joined = f"CONCAT_WS(',', {', '.join(codes)})"
    return f"SELECT model_id, model_version, {joined} AS failures, {joined} = '' AS passed FROM reports"


_RECOMMENDATION = """
SELECT ch.model_id, ROUND(cp.f1_score, 6) AS champion_metric, ROUND(ch.f1_score, 6) AS challenger_metric,
  cp.model_id IS NULL AS is_first_model,
  ROUND(ch.f1_score - cp.f1_score, 6) AS absolute_improvement,
  CASE WHEN cp.f1_score IS NULL OR cp.f1_score = 0 THEN NULL
       ELSE ROUND(ROUND(ch.f1_score - cp.f1_score, 6) / cp.f1_score, 6) END AS relative_improvement,
  COALESCE(ch.f1_score >= cp.f1_score - 0.01, TRUE) AS regression_within_limit,
  CASE WHEN ch.accuracy >= 0.5 AND ch.precision_score >= 0.5 AND ch.recall_score >= 0.5 AND ch.f1_score >= 0.5
        AND ch.roc_auc >= 0.5 AND COALESCE(ch.f1_score >= cp.f1_score - 0.01, TRUE) THEN 'promote' ELSE 'reject' END AS recommendation
FROM (SELECT * FROM model_metrics WHERE model_version = 'R') ch
LEFT JOIN (SELECT * FROM model_metrics WHERE model_version = 'A') cp ON ch.model_id = cp.model_id
"""

_CENTRAL = """
SELECT model_id, CONCAT_WS(',', CASE WHEN a < 0.5 THEN 'accuracy' END, CASE WHEN p < 0.5 THEN 'precision' END,
    CASE WHEN r < 0.5 THEN 'roc_auc' END) AS failures, ok AS absolute_approval,
  CASE WHEN ok AND within THEN 'promote' ELSE 'reject' END AS recommendation
FROM (SELECT *, COALESCE(a, p, r) IS NOT NULL AND COALESCE(a >= 0.5, TRUE) AND COALESCE(p >= 0.5, TRUE) AND COALESCE(r >= 0.5, TRUE) AS ok
  FROM (SELECT ch.model_id, CASE WHEN ch.model_id % 8 <> 0 THEN ch.accuracy END AS a,
          CASE WHEN ch.model_id % 8 <> 0 THEN ch.precision_score END AS p, CASE WHEN ch.model_id % 4 <> 0 THEN ch.roc_auc END AS r,
          COALESCE(ch.f1_score >= cp.f1_score - 0.01, TRUE) AS within
        FROM (SELECT * FROM model_metrics WHERE model_version = 'R') ch
        LEFT JOIN (SELECT * FROM model_metrics WHERE model_version = 'A') cp ON ch.model_id = cp.model_id) x) y
"""

_PROBLEMS = """
SELECT i.model_id, CONCAT_WS(',',
    CASE WHEN r.recommendation <> 'promote' THEN 'not_recommended' END,
    CASE WHEN r.recommendation <> 'promote' THEN 'not_technically_approved' END,
    CASE WHEN rec_version IS DISTINCT FROM run_version THEN 'version_differs_from_run' END,
    CASE WHEN rec_run_id IS DISTINCT FROM run_run_id THEN 'run_id_differs_from_run' END,
    CASE WHEN rec_commit IS DISTINCT FROM run_commit THEN 'commit_differs_from_run' END,
    CASE WHEN COALESCE(approver, '') = '' THEN 'no_approver' END,
    CASE WHEN approval_version IS DISTINCT FROM run_version THEN 'approval_version_differs_from_run' END,
    CASE WHEN approval_run_id IS DISTINCT FROM run_run_id THEN 'approval_run_id_differs_from_run' END) AS problems
FROM promotion_inputs i JOIN recommended r ON i.model_id = r.model_id
"""

_MANIFEST = """
SELECT doc_id, CONCAT_WS(',', CASE WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN 'git_commit' END,
    CASE WHEN SHA256(text) <> SHA256(CASE WHEN doc_id % 17 = 0 THEN text || '!' ELSE text END) THEN 'sha256' END) AS mismatches
FROM documents
"""

_VERSIONS = """
SELECT model_id, version, 'run-' || CAST(MIN(event_id) AS VARCHAR) AS run_id FROM alias_events
WHERE action = 'register' GROUP BY model_id, version
"""

_REQUESTS = """
SELECT model_id, version AS target_version FROM (SELECT model_id, version,
    ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM alias_events WHERE action = 'rollback') x WHERE rn = 1
"""

_ROLLBACK = """
SELECT r.model_id, s.champion_version AS from_version, r.target_version AS to_version, v.run_id AS to_run_id,
  CASE WHEN v.run_id IS NOT NULL THEN s.champion_version END AS will_set_previous_champion_to, TRUE AS dry_run,
  CASE WHEN v.run_id IS NULL THEN 'target_missing' ELSE 'planned' END AS status
FROM requests r LEFT JOIN versions v ON r.model_id = v.model_id AND r.target_version = v.version
LEFT JOIN alias_state s ON r.model_id = s.model_id
"""

_ROLLED_BACK = """
SELECT s.model_id, CASE WHEN a.model_id IS NULL THEN s.champion_version ELSE a.target_version END AS champion_version,
  CASE WHEN a.model_id IS NULL THEN s.previous_champion_version ELSE s.champion_version END AS previous_champion_version,
  s.challenger_version
FROM alias_state s LEFT JOIN (SELECT r.* FROM requests r JOIN versions v ON r.model_id = v.model_id
  AND r.target_version = v.version WHERE r.model_id % 3 <> 0) a ON s.model_id = a.model_id
"""

_PLAN = """
SELECT s.model_id, s.challenger_version AS challenger_version_to_promote, s.champion_version AS current_champion_version,
  s.champion_version AS will_set_previous_champion_to, s.challenger_version AS will_set_champion_to,
  CASE WHEN k.problems = '' THEN 'promote' ELSE 'refuse' END AS action, TRUE AS dry_run
FROM alias_state s JOIN checked k ON s.model_id = k.model_id
"""

_NEW_VERSIONS = """
SELECT e.model_id, e.event_id, CAST(COALESCE(h.highest, 0) + ROW_NUMBER() OVER (PARTITION BY e.model_id ORDER BY e.ts, e.event_id) AS BIGINT) AS version
FROM alias_events e LEFT JOIN (SELECT model_id, MAX(version) AS highest FROM alias_events WHERE action = 'register' GROUP BY model_id) h
  ON e.model_id = h.model_id WHERE e.action = 'promote'
"""

_HISTORY = """
SELECT model_id, event_id, action, version, LAG(version) OVER (PARTITION BY model_id ORDER BY ts, event_id) AS previous_version
FROM alias_events WHERE action IN ('promote', 'rollback')
"""


def _run_values_sql() -> str:
    run, none = "CAST(model_id AS VARCHAR) || '-' || model_version", "CAST(NULL AS DOUBLE)"
    parts = [
        f"SELECT {run} AS run_id, 'metrics' AS section, '{name}' AS name, ROUND({c}, 6) AS number, CAST(NULL AS VARCHAR) AS text FROM model_metrics"
        for name, c in _COLUMNS.items()
    ]
    for section, name, text, where in (
        ("params", "algorithm", "'logistic_regression'", ""),
        ("params", "hp_max_iter", "'50'", ""),
        ("tags", "model_name", "'model-' || CAST(model_id AS VARCHAR)", ""),
        ("tags", "model_alias", "'challenger'", " WHERE model_version = 'R'"),
    ):
        parts.append(f"SELECT {run}, '{section}', '{name}', {none}, {text} FROM model_metrics{where}")
    return "\nUNION ALL ".join(parts)


ORACLES = {
    "run_signature": over(
        "churn model_metrics",
        "SELECT CONCAT_WS('-', model_id, model_version) AS run_id, "
        f"'{','.join((*i.NUMERIC, *i.CATEGORICAL))}' AS inputs, 'prediction,probability_churn' AS outputs, tenure_months, monthly_charges "
        f"FROM model_metrics, (SELECT * FROM churn ORDER BY {', '.join(f'{c} NULLS FIRST' for c in (*i.NUMERIC, *i.CATEGORICAL))} LIMIT 1) e",
    ),
    "metric_gate": over("model_metrics", _gate_sql(), reports=_GATE_INPUT),
    "promotion_recommendation": over("model_metrics", _RECOMMENDATION),
    "promotion_recommendation_tables": over("model_metrics", _RECOMMENDATION),
    "promotion_recommendation_central": over("model_metrics", _CENTRAL),
    "promotion_metadata_check": over(
        "promotion_inputs",
        "SELECT model_id, problems, problems = '' AS consistent FROM checked",
        recommended=_RECOMMENDATION,
        checked=_PROBLEMS,
    ),
    "manifest_check": over("", "SELECT doc_id, mismatches, mismatches = '' AS intact FROM m", m=_MANIFEST),
    "alias_state": over("alias_state", "SELECT * FROM alias_state"),
    "alias_history": over("alias_events", _HISTORY),
    "model_versions": over("alias_events", _NEW_VERSIONS),
    "promotion_plan": over("alias_state promotion_inputs", _PLAN, recommended=_RECOMMENDATION, checked=_PROBLEMS),
    "rollback_plan": over("alias_state", _ROLLBACK, versions=_VERSIONS, requests=_REQUESTS),
    "rollback_applied": over("alias_state", _ROLLED_BACK, versions=_VERSIONS, requests=_REQUESTS),
    "run_table": over("model_metrics", _run_values_sql()),
}
