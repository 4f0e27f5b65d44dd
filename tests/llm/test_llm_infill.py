from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from cases import AWKWARD, documents
from oracle import compare, duck
from pyspark.sql import functions as F

from gaugeworks.llm import infill


def brute(key, text, plain=90, spm=20):
    """Cut code point by code point with Python's own strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < spm:
        return key, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return key, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def noise(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    pieces = ["a", "é", "☃", "\U0001f600", " ", "\n", "<", "S>", "<P", ">", "é", "\x00"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(300)))) for i in range(200)]
    return rows + [(200, "x <P> y"), (201, "<M>"), (202, "<S"), (203, "<S>" * 3)]


@pytest.mark.parametrize("block", [1, 3, 64, 1024])
def test_rows_equal_plain_slicing(spark, block):
    rows = AWKWARD + noise(block)
    got = infill.transform(documents(spark, rows), block=block)
    want = [brute(*row) for row in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {"psm", "spm", "plain"} == {w[2] for w in want}


def test_texts_come_back_from_output_and_form(spark):
    rows = AWKWARD + noise(7)
    for plain, spm in ((10, 20), (0, 100), (0, 0), (100, 50)):
        got = infill.transform(documents(spark, rows), block=16, plain=plain, spm=spm)
        back = got.select("doc_id", infill.restored(F.col("form"), F.col("output")).alias("t")).collect()
        assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


@pytest.mark.parametrize("unit", ["code point", "word"])
@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_every_cut(unit, block):
    rng = random.Random(block)
    for _ in range(40):
        text = "".join(rng.choice(["a", "bc", "é", "☃", " ", "  ", "\n"]) for _ in range(rng.randrange(60)))
        data = np.frombuffer(text.encode(), np.uint8)
        starts = list(range(len(text))) if unit == "code point" else [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        laid = infill.Layout(data, unit, block)
        assert laid.units == len(starts)
        for k in range(laid.units + 1):
            want = 0 if k == 0 else starts[k] if k < len(starts) else len(text)
            assert laid.cut(k) == (len(text[:want].encode()), want)


def test_tree_sums_and_descends():
    rng = random.Random(5)
    for size in (0, 1, 2, 3, 8, 13, 100):
        counts = [rng.choice([0, 0, 1, 5]) for _ in range(size)]
        tree = infill.Fenwick(counts)
        for block in range(size + 1):
            assert tree.before(block) == sum(counts[:block])
        for count in range(sum(counts) + 2):
            blocks = max(b for b in range(size + 1) if sum(counts[:b]) <= count)
            assert tree.descend(count) == (blocks, count - sum(counts[:blocks]))


def test_empty_table_and_unknown_unit(spark):
    assert infill.transform(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        infill.transform(documents(spark, []), unit="line")


def test_query_equals_sql(spark, sf_dir):
    name = "op13_fill_in_middle"
    assert compare(infill.QUERIES[name](spark, sf_dir), duck(sf_dir), infill.ORACLES[name]) == []
