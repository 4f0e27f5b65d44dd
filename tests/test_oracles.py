"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest
from oracle import compare, duck

import __spark_entry__ as entry_module
from gaugeworks.operators.profile import profile_numeric

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duck(sf_dir)
    yield connection
    connection.close()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(set(QUERIES) & set(ORACLES)))
def test_query_equals_sql(spark, sf_dir, con, key):
    assert compare(QUERIES[key](spark, sf_dir), con, ORACLES[key]) == []


def test_rows_only_queries(spark, sf_dir):
    for key in sorted(set(QUERIES) - set(ORACLES)):
        assert not QUERIES[key](spark, sf_dir).isEmpty(), key


def test_approximate_quantiles_are_close(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    columns = ["l_quantity", "l_extendedprice", "l_tax"]
    exact, close = (
        {r["column"]: r for r in profile_numeric(lines, columns, exact=flag).collect()} for flag in (True, False)
    )
    for c in columns:
        spread = exact[c]["max"] - exact[c]["min"]
        assert all(abs(a - b) <= 0.01 * spread for a, b in zip(exact[c]["quantiles"], close[c]["quantiles"]))


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["rule"] for r in rows} >= {"row_count", "duplicates[customer_id]", "target_distribution[churn]"}
