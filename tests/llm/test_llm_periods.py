from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from cases import AWKWARD, LONG, documents

from gaugeworks.llm import periods


def brute_runs(words, repeats=4, least=6):
    """Every stretch for every period, dropping those that a smaller period explains."""
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.append((i, j + q - i, q))
            i = j + 1 if j == i or j + q < n else n
    least_period = {}
    for s, length, q in found:
        least_period.setdefault((s, length), q)
    return sorted((s, length, q) for s, length, q in found if least_period[s, length] == q)


def brute_kept(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def noise(rng, size):
    """Words with repeats of repeats in them."""
    words: list[str] = []
    while len(words) < size:
        part = [rng.choice("abcde") for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.5:
            part = (part * rng.randrange(2, 8))[: rng.randrange(1, 40)]
        if words and rng.random() < 0.3:
            back = rng.randrange(1, min(len(words), 60) + 1)
            part = (words[-back:] * rng.randrange(1, 6))[: rng.randrange(1, 200)]
        words += part
    return words[:size]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [noise(rng, rng.randrange(0, 160)) for _ in range(60)]
    coded = [[w.encode() for w in t] for t in texts]
    for repeats, least in ((4, 6), (3, 1), (6, 20)):
        for part in (coded, coded[:1], coded[7:9]):
            got = [[tuple(r) for r in runs] for runs in periods.runs_of(part, repeats, least)]
            assert got == [brute_runs(t, repeats, least) for t in part]


def test_few_candidates_at_a_time(monkeypatch):
    monkeypatch.setattr(periods, "CANDIDATES", 5)
    rng = random.Random(11)
    texts = [[w.encode() for w in noise(rng, 120)] for _ in range(20)] + [[b"a"] * 300]
    assert [[tuple(r) for r in runs] for runs in periods.runs_of(texts)] == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("letters", [1, 2, 4, 30])
def test_extensions_equal_comparing(letters):
    rng = random.Random(letters)
    for size in (1, 2, 17, 400):
        text = [rng.randrange(letters) for _ in range(size)]
        if letters == 4:
            text = (text[: size // 7 + 1] * 8)[:size]
        whole = np.array([letters, *text, letters + 1], np.int64)
        grammar = periods.Grammar(whole, enough=rng.choice([1, 8]))
        a = np.array([rng.randrange(1, size + 1) for _ in range(300)])
        b = np.array([rng.randrange(x, size + 2) for x in a])
        a, b = a[a < b], b[a < b]

        def plain(x, y, step):
            n = 0
            while whole[x + step * n] == whole[y + step * n]:
                n += 1
            return n

        assert grammar.extensions(a, b).tolist() == [plain(x, y, 1) for x, y in zip(a, b)]
        mirror, last = grammar.mirrored(), len(whole) - 1
        assert mirror.extensions(last - b, last - a).tolist() == [plain(x, y, -1) for x, y in zip(a, b)]


def test_grammar_expands_to_its_text():
    rng = random.Random(2)
    whole = np.array([rng.randrange(3) for _ in range(500)] + [3], np.int64)
    grammar = periods.Grammar(whole)
    assert len(grammar.symbols[-1]) <= 8
    for level, (first, parent) in enumerate(zip(grammar.first, grammar.parent)):
        content: dict[int, tuple] = {}
        for k, name in enumerate(grammar.symbols[level + 1]):
            part = tuple(grammar.symbols[level][first[k] : first[k + 1]])
            assert content.setdefault(int(name), part) == part
            assert (parent[first[k] : first[k + 1]] == k).all()
        assert len(set(content.values())) == len(content)


def test_documents(spark):
    rng = random.Random(4)
    rows = AWKWARD + [(20 + k, " ".join(noise(rng, 90))) for k in range(30)] + [(90, "a " * 5), (91, "A\u0085a " * 9), (92, "x\x0bx\x0cx x\nx\tx")]
    for size in (1, 300, 1 << 16):
        got = periods.periodic_runs(documents(spark, rows), chunk_words=size).collect()
        want = []
        for key, text in rows:
            words = (text or "").encode().split()
            runs = brute_runs(words) if text != LONG else periods.runs_of([words])[0].tolist()
            want.append((key, len(words), [tuple(r) for r in runs], b" ".join(brute_kept(words, runs)).decode()))
        assert sorted(((k, n, [tuple(r) for r in runs], t) for k, n, runs, t in got), key=repr) == sorted(want, key=repr)
    assert periods.periodic_runs(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periods.periodic_runs(documents(spark, []), repeats=2)


def test_long_texts_take_seconds():
    rng = random.Random(9)
    alone = [b"a"] * 300_000
    passage = [b"w%d" % rng.randrange(9_000) for _ in range(60_000)]
    mixed = [b"w%d" % rng.randrange(9_000) for _ in range(40_000)] + passage * 4 + passage[:7]
    began = time.time()
    assert periods.runs_of([alone])[0].tolist() == [[0, 300_000, 1]]
    assert [0 + 40_000, 240_007, 60_000] in periods.runs_of([mixed])[0].tolist()
    assert time.time() - began < 60


def brute_query(key, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words) if n < 800 else [tuple(r) for r in periods.runs_of([words])[0].tolist()]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda data: hashlib.sha256(data).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return key, len(runs), *best, milli, digest(lines.encode()), digest(b" ".join(brute_kept(words, runs)))


def test_query_equals_brute_force(spark, sf_dir):
    got = periods.op12_periodic_runs(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute_query(i, t) for i, t in docs)
    assert sorted(tuple(r) for r in got) == want
    assert sum(r["n_runs"] > 0 for r in got) > 50
