"""Compare a query with its oracle SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> list[str]:
    """Differences, empty when both sides agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = _rows(names, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    for name, kind in df.dtypes:
        want = kinds.get(types[name])
        if want is not None and want != kind:
            problems.append(f"type of {name}: {kind} != {types[name]}")
        if want is None and types[name] in ("HUGEINT",) :
            problems.append(f"type of {name}: {types[name]} in the oracle")
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows != {len(expected)}")
    for a, e in zip(actual, expected):
        if a != e:
            problems.append(f"first difference: {a} != {e}")
            break
    return problems
