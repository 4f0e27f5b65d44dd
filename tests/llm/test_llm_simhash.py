from __future__ import annotations

import random

import xxhash
from cases import AWKWARD, documents

from gaugeworks.llm import simhash


def brute_print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_pieces_of_long_texts_change_nothing():
    from gaugeworks.llm.base import byte_words, run_hashes, slices

    rng = random.Random(1)
    for size in (1, 2, 5, 40):
        text = "".join(rng.choice(["a", "Bc", " ", "\n ", "\t", "é", "\x0b"]) for _ in range(rng.randrange(200)))
        assert "".join(slices(text, size)) == text
        for width in (1, 3, 5):
            words = byte_words(text)
            runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
            got = [int(h) for part in run_hashes(map(byte_words, slices(text, size)), width) for h in part]
            assert got == [xxhash.xxh64_intdigest(r, 42) for r in runs]


def brute_components(prints: list[tuple[int | None, int]]) -> list[int | None]:
    groups = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and groups[b] < groups[a]:
                    groups[a], changed = groups[b], True
    least = {g: min((k for (k, _), h in zip(prints, groups) if h == g and k is not None), default=None) for g in groups}
    return [least[g] for g in groups]


def check(spark, rows):
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    want = [(i, format(p, "016x"), c) for (i, p), c in zip(prints, brute_components(prints))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_awkward_documents(spark):
    check(spark, AWKWARD)
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_near_copies_link_through_others(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    rows = [(0, " ".join(words))]
    for n in range(1, 60):
        words = list(words)
        words[rng.randrange(600)] = f"v{n}"
        rows.append((n, " ".join(words)))
    rows += [(100 + n, " ".join(f"z{rng.randrange(900)}" for _ in range(80))) for n in range(20)]
    rng.shuffle(rows)
    check(spark, rows)


def test_every_pair_within_three_bits_is_linked(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for value in base:
        for bits in (1, 2, 3, 4):
            for _ in range(4):
                flipped = value
                for bit in rng.sample(range(64), bits):
                    flipped ^= 1 << bit
                values.add(flipped)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(300)] + [(1000, 1001)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert len(found) == 303 and len(set(found[n] for n in range(301))) == 1 and found[1000] == found[1001] != found[0]
