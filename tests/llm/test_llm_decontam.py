from __future__ import annotations

import random

import regex
from cases import AWKWARD, PROSE, documents

from gaugeworks.llm import decontam
from gaugeworks.llm.base import table


def grams(text):
    words = regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    found = set()
    sets = [(key, grams(text)) for key, text in docs]
    for item, text in items:
        own = grams(text)
        for key, theirs in sets:
            if own and len(own & theirs) >= 0.8 * len(own) - 1e-9:
                found.add((key, item, len(own & theirs), len(own)))
    return found


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def check(spark, docs, items):
    want = brute(docs, items)
    for most in (decontam.SENT_SHINGLES, 0):
        got = decontam.matches(documents(spark, docs), frame(spark, items), most=most).collect()
        assert {tuple(r)[:4] for r in got} == want
        assert all(abs(r["containment"] - r["shared"] / r["item_shingles"]) < 1e-12 for r in got)
        kept = decontam.clean(documents(spark, docs), frame(spark, items), most=most)
        dirty = {k for k, *_ in want}
        assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((k for k, _ in docs if k not in dirty), key=repr)
    return want


def test_whole_tables(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    got = {tuple(r)[:4] for r in decontam.op9_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == brute(docs, items) and got


def test_changed_cut_and_short_items(spark):
    rng = random.Random(8)
    items = [(n, " ".join(f"t{rng.randrange(3000)}" for _ in range(size))) for n, size in enumerate([5, 6, 9, 20, 40, 120, 400, 3, 1])]
    items += [(20, None), (21, ""), (22, "!!"), (23, items[3][1]), (None, items[4][1])]
    docs = list(AWKWARD)
    docs = [(k, t) for k, t in docs if k is not None]
    for n, (_, text) in enumerate(items[:9]):
        words = text.split()
        for share in (1.0, 0.95, 0.85, 0.8, 0.7, 0.4):
            some = words[: max(1, int(len(words) * share))]
            docs.append((1000 + 100 * n + int(share * 20), PROSE.upper() + " -- " + ", ".join(some).title() + ". " + PROSE))
    docs += [(900, items[7][1]), (901, items[8][1] + "!"), (902, items[5][1].replace("t1", "u1"))]
    want = check(spark, docs, items)
    assert {20, 21, 22}.isdisjoint(i for _, i, *_ in want) and any(i == 7 for _, i, *_ in want)


def test_empty_tables(spark):
    check(spark, [], [(1, PROSE)])
    check(spark, [(1, PROSE)], [])


def test_a_document_of_many_items(spark):
    items = [(n, " ".join(f"a{n}x{k}" for k in range(12))) for n in range(300)]
    check(spark, [(1, " . ".join(t for _, t in items)), (2, PROSE)], items)
