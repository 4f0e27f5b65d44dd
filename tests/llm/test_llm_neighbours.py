from __future__ import annotations

import math

import numpy as np
from oracle import compare, duck

from gaugeworks.llm import neighbours as n

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v int, score int, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", 1, 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            near = sorted({(float(np.sqrt(sum((a - b) ** 2))), i) for i, b in good if i != q and len(a) == len(b)})
            best = {}
            for d, i in near:
                best.setdefault(i, d)
            out[q] = [(r + 1, i, d) for r, (i, d) in enumerate(list(best.items())[:k] and list((i, d) for i, d in best.items())[:k])]
    return {q: v for q, v in out.items() if v}


def check(spark, rows, **limits):
    got = {}
    for r in n.nearest(vectors(spark, rows), lambda key: key % 100 == 0, **limits).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [x[:2] for x in sorted(got[q])] == [x[:2] for x in want[q]]
        assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(sorted(got[q]), want[q]))


def test_equals_sql(spark, sf_dir):
    assert compare(n.op8_nearest_neighbours(spark, sf_dir), duck(sf_dir), n.ORACLES["op8_nearest_neighbours"]) == []


def test_many_blocks_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=8) * 10 ** rng.uniform(-3, 3)).tolist()) for k in range(700)]
    rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(2000 + k, [1.0, 2.0] * 4) for k in range(101)]
    check(spark, rows, query_block=3, vector_block=40)


def test_more_copies_of_one_row_than_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 1.0, 1.0])] + [(k, (1 + rng.normal(size=3)).tolist()) for k in range(1, 30)]
    rows += [(50, [1.0, 1.0, 1.01])] * 12 + [(51, [1.0, 1.0 + k / 100, 1.0]) for k in range(1, 13)] + [(0, [1.0, 1.0, 1.0])] * 5
    check(spark, rows)
    check(spark, rows, query_block=1, vector_block=20)


def test_copies_in_several_parts_of_a_tile(monkeypatch):
    monkeypatch.setattr(n, "_TILE", 5)
    vectors = np.array([[1.0, 1.0 + d] for d in (0.9, 0.1, 0.1, 0.3, 0.1, 0.1, 0.1, 0.2, 0.8, 0.1, 0.4, 0.5)])
    keys = np.array([1, 2, 2, 3, 2, 2, 1, 4, 5, 2, 6, 7])
    got = n.tile(np.array([[1.0, 1.0]]), np.array([100]), vectors, keys, 4)
    assert sorted((round(d, 9), key) for _, key, d in got) == [(0.1, 1), (0.1, 2), (0.2, 4), (0.3, 3)]


def test_vectors_that_take_no_part(spark):
    odd = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, []), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [1.0, None]), (None, [1.0, 1.0]),
           (1, [1.0, 1e-30]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (3, [1.0, 2.0, 3.0]), (700, [5.0, 6.0, 7.0])]
    check(spark, odd)
    check(spark, [(100, [1.0])])
    check(spark, [])


def test_bounds_hold():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(500, 32))
    codes, scale, error = n.quantised(rows)
    back = codes * scale[:, None]
    assert np.allclose(np.sqrt(((rows - back) ** 2).sum(axis=1)), error)
    true = np.sqrt(((rows[:1] - rows) ** 2).sum(axis=1))
    near = np.sqrt(((back[:1] - back) ** 2).sum(axis=1))
    assert (np.abs(true - near) <= error[0] + error + 1e-12).all()


def test_components_near_the_end_of_the_range(monkeypatch):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(40, 6))
    for size in (1e-200, 1.0, 1e100, 1e160, 1e300):
        scaled = vectors * size
        scaled[5] = scaled[0] * (1 + 1e-9)
        for step in (7, 64):
            monkeypatch.setattr(n, "_TILE", step)
            found = sorted(n.tile(scaled[:3], np.arange(3), scaled, np.arange(40), 10))
            near = {}
            for q, key, d in found:
                near.setdefault(q, []).append((d, key))
            for q in range(3):
                relative = scaled / size - scaled[q] / size
                order = sorted((float(np.sqrt((r * r).sum())), k) for k, r in enumerate(relative) if k != q)[:10]
                if size >= 1:
                    assert [k for _, k in sorted(near[q])] == [k for _, k in order]
                    assert all(abs(d / size - w) <= 1e-9 * w + 1e-12 for (d, _), (w, _) in zip(sorted(near[q]), order))
                assert len(near[q]) == 10
