"""The input frames once more, as SQL common table expressions for the oracle queries."""

from __future__ import annotations

CHURN = """
SELECT CAST(c.c_custkey AS VARCHAR) AS customer_id,
  CAST(COALESCE((YEAR(o.last_dt)-YEAR(o.first_dt))*12 + MONTH(o.last_dt)-MONTH(o.first_dt), 0) AS INT) AS tenure_months,
  c.c_acctbal AS monthly_charges,
  CAST(o.total AS DOUBLE) AS total_charges,
  CASE WHEN c.c_mktsegment IN ('BUILDING','MACHINERY') THEN 'month-to-month'
       WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'one-year' ELSE 'two-year' END AS contract_type,
  CASE WHEN n.n_regionkey IN (0,1) THEN 'dsl' WHEN n.n_regionkey IN (2,3) THEN 'fiber' ELSE 'none' END AS internet_service,
  CAST(o.urgent AS INT) AS support_calls,
  COALESCE(o.last_dt >= TIMESTAMP '2001-01-01 00:00:00', FALSE) AS is_active,
  CAST(o.first_dt AS DATE) AS signup_date,
  CAST(CASE WHEN COALESCE(o.last_dt >= TIMESTAMP '2001-01-01 00:00:00', FALSE) THEN 0 ELSE 1 END AS INT) AS churn
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_dt, MAX(o_orderdate) AS last_dt,
             SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total,
             SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS urgent
           FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
"""

CHURN_DIRTY = """
SELECT customer_id, tenure_months, monthly_charges,
  CASE WHEN CAST(customer_id AS INT) % 13 = 0 THEN NULL ELSE total_charges END AS total_charges,
  CASE WHEN CAST(customer_id AS INT) % 97 = 0 THEN 'weekly'
       WHEN CAST(customer_id AS INT) % 89 = 0 THEN NULL ELSE contract_type END AS contract_type,
  internet_service,
  CASE WHEN CAST(customer_id AS INT) % 7 = 0 THEN NULL ELSE support_calls END AS support_calls,
  is_active, signup_date, churn
FROM churn
UNION ALL
SELECT customer_id, tenure_months, monthly_charges, total_charges, contract_type, internet_service,
  support_calls, is_active, signup_date, churn
FROM churn WHERE CAST(customer_id AS INT) % 50 = 0
"""

SCORED = """
SELECT customer_id, churn AS label,
  CASE WHEN CAST(customer_id AS INT) % 101 = 0 THEN NULL
       WHEN tenure_months < 66 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS prediction,
  CAST(78 - tenure_months AS DOUBLE) / CAST(78 AS DOUBLE) AS score
FROM churn
"""

MODEL_METRICS = """
SELECT model_id, model_version, n_rows, accuracy, precision_score, recall_score,
  CAST(2 AS DOUBLE) * precision_score * recall_score / (precision_score + recall_score) AS f1_score, roc_auc
FROM (SELECT l_suppkey AS model_id, l_returnflag AS model_version, COUNT(*) AS n_rows,
        CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS accuracy,
        CAST(SUM(CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS precision_score,
        CAST(SUM(CASE WHEN l_discount >= 0.045 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS recall_score,
        CAST(SUM(CASE WHEN l_tax >= 0.035 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS roc_auc
      FROM lineitem GROUP BY l_suppkey, l_returnflag) m
WHERE NOT (model_version = 'A' AND model_id % 10 = 0)
"""

PROMOTION_INPUTS = """
SELECT model_id, 'R' AS rec_version, CASE WHEN model_id % 7 = 0 THEN 'N' ELSE 'R' END AS run_version,
  'run-' || CAST(model_id AS VARCHAR) AS rec_run_id,
  CASE WHEN model_id % 5 = 0 THEN 'other' ELSE 'run-' || CAST(model_id AS VARCHAR) END AS run_run_id,
  'c0ffee' AS rec_commit, CASE WHEN model_id % 9 = 0 THEN 'deadbe' ELSE 'c0ffee' END AS run_commit,
  CASE WHEN model_id % 11 = 0 THEN NULL ELSE 'approver-1' END AS approver,
  'R' AS approval_version, 'run-' || CAST(model_id AS VARCHAR) AS approval_run_id
FROM (SELECT DISTINCT model_id FROM model_metrics) d
"""

ALIAS_EVENTS = """
SELECT event_id, ts, CAST(user_id AS BIGINT) AS model_id,
  CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'promote' ELSE 'rollback' END AS action,
  CAST(event_id % 40 AS BIGINT) AS version
FROM events WHERE event_type IN ('signup','purchase','error')
"""

SNAPSHOT_BEFORE = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0"

SNAPSHOT_AFTER = """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM customer WHERE c_custkey % 10 <> 1
"""

BUCKETED = """
SELECT *, CAST('0x' || SUBSTR(MD5('42:' || customer_id), 1, 8) AS BIGINT) % 10000 AS b FROM churn
"""

SPLITS = """
SELECT *, CASE WHEN b < 7000 THEN 'train' WHEN b < 8500 THEN 'validation' ELSE 'test' END AS split FROM bucketed
"""

# (model_id, champion, previous champion, challenger), from the events.
ALIAS_STATE = """
SELECT k.model_id, c.champion_version, c.previous_champion_version, r.challenger_version
FROM (SELECT DISTINCT model_id FROM alias_events) k
LEFT JOIN (SELECT model_id, version AS champion_version,
        LAG(version) OVER (PARTITION BY model_id ORDER BY ts, event_id) AS previous_champion_version,
        ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM alias_events WHERE action IN ('promote','rollback')) c ON c.model_id = k.model_id AND c.rn = 1
LEFT JOIN (SELECT model_id, version AS challenger_version,
        ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM alias_events WHERE action = 'register') r ON r.model_id = k.model_id AND r.rn = 1
"""

CLASSIFICATION = """
SELECT ROUND(SUM(tp) / SUM(lab), 6) AS accuracy,
  ROUND(SUM(lab * prc) / SUM(lab), 6) AS "precision",
  ROUND(SUM(lab * rec) / SUM(lab), 6) AS recall,
  ROUND(SUM(lab * CASE WHEN prc + rec = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * prc * rec / (prc + rec) END) / SUM(lab), 6) AS f1_score,
  ROUND(1 - SUM(tp) / SUM(lab), 6) AS error_rate
FROM (SELECT l.c, CAST(l.lab AS DOUBLE) AS lab, CAST(l.tp AS DOUBLE) AS tp,
        CASE WHEN COALESCE(p.n, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(l.tp AS DOUBLE) / CAST(p.n AS DOUBLE) END AS prc,
        CAST(l.tp AS DOUBLE) / CAST(l.lab AS DOUBLE) AS rec
      FROM (SELECT label AS c, COUNT(*) AS lab, SUM(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS tp
            FROM scored WHERE prediction IS NOT NULL GROUP BY label) l
      LEFT JOIN (SELECT CAST(prediction AS INT) AS c, COUNT(*) AS n FROM scored WHERE prediction IS NOT NULL
                 GROUP BY CAST(prediction AS INT)) p ON l.c = p.c) t
"""

AUC = """
SELECT ROUND(CAST(SUM(pos * (2 * (cum_neg - neg) + neg)) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE), 6) AS roc_auc
FROM (SELECT pos, neg, CAST(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_neg
      FROM (SELECT score, CAST(SUM(label) AS BIGINT) AS pos, CAST(SUM(1 - label) AS BIGINT) AS neg FROM scored GROUP BY score) g) w
"""

# name -> (names it builds on, body)
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "churn": ((), CHURN),
    "churn_dirty": (("churn",), CHURN_DIRTY),
    "scored": (("churn",), SCORED),
    "model_metrics": ((), MODEL_METRICS),
    "promotion_inputs": (("model_metrics",), PROMOTION_INPUTS),
    "alias_events": ((), ALIAS_EVENTS),
    "snapshot_before": ((), SNAPSHOT_BEFORE),
    "snapshot_after": ((), SNAPSHOT_AFTER),
    "bucketed": (("churn",), BUCKETED),
    "splits": (("bucketed",), SPLITS),
    "alias_state": (("alias_events",), ALIAS_STATE),
    "classification": (("scored",), CLASSIFICATION),
    "auc": (("scored",), AUC),
}


def over(names: str, body: str, **extra: str) -> str:
    """``body`` with the named inputs (space-separated) as CTEs; ``extra`` adds CTEs of its own."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in _PARTS[name][0]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({_PARTS[n][1].strip()})" for n in ordered]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)}\n{body.strip()}" if parts else body.strip()
