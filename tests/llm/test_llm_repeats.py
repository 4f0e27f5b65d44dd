from __future__ import annotations

import random

import numpy as np
import pytest
from cases import AWKWARD, LONG, PROSE, documents
from oracle import compare, duck

from gaugeworks.llm import repeats


def brute(rows, window=13):
    """Every window of every document, against the least key that has it."""
    order = lambda k: repeats._LAST if k is None else k
    split = [(k, (t or "").encode().split()) for k, t in rows]
    least: dict[tuple, int] = {}
    for k, words in split:
        for i in range(len(words) - window + 1):
            gram = tuple(words[i : i + window])
            least[gram] = min(least.get(gram, repeats._LAST), order(k))
    found = []
    for k, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < order(k):
                gone.update(range(i, i + window))
        spans, i = [], 0
        while i < len(words):
            j = i
            while j in gone:
                j += 1
            if j > i:
                spans.append((i, j - i))
            i = max(j, i + 1)
        found.append((k, len(words), spans, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(found, key=repr)


def check(spark, rows, window=13, **options):
    got = repeats.without_repeats(documents(spark, rows), window, **options).collect()
    assert sorted(((k, n, [tuple(s) for s in removed], t) for k, n, removed, t in got), key=repr) == brute(rows, window)


def noise(seed, count=60):
    """Documents that share passages of many lengths, some around the window."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", f"w{rng.randrange(50)}"])
    passages = [[word() for _ in range(rng.randrange(5, 40))] for _ in range(8)]
    rows = []
    for key in rng.sample(range(-500, 500), count):
        words: list[str] = []
        for _ in range(rng.randrange(6)):
            words += [word() for _ in range(rng.randrange(15))]
            part = rng.choice(passages)
            words += part[rng.randrange(3) : len(part) - rng.randrange(3)]
        rows.append((key, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


def test_awkward_documents(spark):
    check(spark, AWKWARD)
    check(spark, AWKWARD + [(1, PROSE), (0, LONG[:9000]), (12, LONG + " end"), (-3, None)], chunk_words=50)
    assert repeats.without_repeats(documents(spark, [])).collect() == []


@pytest.mark.parametrize(("seed", "window", "chunk", "chars"), [(1, 13, 1 << 17, 1 << 24), (2, 13, 40, 100), (3, 6, 1, 300), (4, 1, 90, 1 << 20), (5, 2, 200, 50)])
def test_noise_equals_brute_force(spark, seed, window, chunk, chars):
    check(spark, noise(seed), window, chunk_words=chunk, bucket_chars=chars)


def test_far_keys_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    check(spark, [(-(1 << 62), text), (1 << 62, "x " + text), (1 << 62, text + " y"), (None, text), (None, text)], chunk_words=1)


def test_a_window_that_repeats_within_one_document_stays(spark):
    text = " ".join(f"w{i % 20}" for i in range(200))
    check(spark, [(5, text), (6, "other words " + text[:300])])


def test_rolling_hashes_do_not_depend_on_the_place():
    powers = repeats._Powers()
    words = [b"w%d" % (i % 50) for i in range(400)]
    one = repeats.Chunk(b" ".join(words) + b"\n", np.zeros(1, np.int64), 13, powers).rolling
    assert (one[:344] == one[50:]).all() and len(set(one.tolist())) == 50
    many = repeats.Chunk(b"\n" + b" ".join(words[:100]) + b"\n\n" + b" ".join(words[100:]) + b"\n", np.zeros(4, np.int64), 13, powers)
    assert many.sizes.tolist() == [0, 100, 0, 300] and (many.rolling == one).all()
    assert len(many.inside(13)) == 88 + 288


def test_texts_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = repeats.without_repeats(documents(spark, noise(8)))
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    data = [line for line in plan.splitlines() if "Exchange" in line and "data" in line]
    assert not data and "Bucketed: true" in plan


def test_query_equals_sql(spark, sf_dir):
    name = "op11_substring_dedup"
    assert compare(repeats.QUERIES[name](spark, sf_dir), duck(sf_dir), repeats.ORACLES[name]) == []
