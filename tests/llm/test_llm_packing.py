from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import packing
from gaugeworks.llm.base import table

PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def want_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check(tokenizer, rows, got, length=2048):
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    for key, text in rows:
        ids = want_ids(tokenizer, text)
        cut = [ids[a : a + length] for a in range(0, len(ids), length)]
        own = sorted(pieces[key], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (n, n * length, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for n, c in enumerate(cut)
        ]
    return len(sequences)


def test_whole_table(spark, sf_dir, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = packing.op3_best_fit_packing(spark, sf_dir).collect()
    count = check(tokenizer, rows, got)
    total = sum(r["length"] for r in got)
    assert count <= -(-total // 2048) + 1 + 0.005 * count


def test_awkward_documents(spark, tokenizer):
    rows = [(i, t) for i, t in AWKWARD if i not in (None, 2)]
    check(tokenizer, rows, packing.pack(documents(spark, rows), PATH).collect())
    all_rows = packing.pack(documents(spark, AWKWARD), PATH).collect()
    assert sum(r["piece"] == 0 for r in all_rows) == len(AWKWARD)
    assert packing.pack(documents(spark, []), PATH).collect() == []


def test_ids_come_back_from_the_sequences(spark, tokenizer):
    rows = [(n, f"document {n} " * (n % 7)) for n in range(50)]
    got = packing.pack(documents(spark, rows), PATH, length=64, block=10, ids=True).collect()
    back = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        back.setdefault(r["doc_id"], []).extend(r["ids"])
    assert back == {i: want_ids(tokenizer, t) for i, t in rows}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from("abcXYZ.,'’-<|>éÉßẖİΣ \n\t0½²"), max_size=40), max_size=4))
def test_chunks_have_the_tokenizers_ids(tokenizer, encoder, batch):
    batch = [*batch, "<|endoftext|> <|ENDOFTEXT|> don't CAN'T we'LL x's", "Ḵ ẖ a\u0085b\x1cc"]
    for text, raw in zip(batch, encoder.encode(batch)):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_bound_changes_nothing(tokenizer):
    small = packing.Encoder(PATH, most=5)
    batch = ["one two three", "four five six seven", "one two eight, nine."]
    assert [np.frombuffer(b, "<u4").tolist() for b in small.encode(batch)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in batch]
    assert len(list(small.encode(batch))) == 3


def test_cache_keeps_what_recurs_within_its_bound(tokenizer):
    small, learned = packing.Encoder(PATH, most=100), []
    learn = small.learn
    small.learn = lambda chunks: (learned.extend(chunks), learn(chunks))
    for k in range(60):
        batch = [" ".join(["often", *(f"rare{10 * k + n}" for n in range(10))])]
        assert np.frombuffer(next(small.encode(batch)), "<u4").tolist() == tokenizer.encode(batch[0], add_special_tokens=False).ids
        held = sum(len(part) for part in vars(small).values() if isinstance(part, dict))
        assert held <= 100
    assert learned.count("often") == 1


def test_a_batch_of_new_chunks_is_cut_in_one_call(tokenizer):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.pattern, name)

    encoder = packing.Encoder(PATH)
    encoder.pieces = Counted(encoder.pieces)
    batch = ["".join(f"word{n}, It's{n % 7}\x1f Été.{n} " for n in range(300)), "a\xa0b \x0b \x85c\x0cd \xa0 İx <| don't\x00 ½²"]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(batch)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in batch]
    assert encoder.pieces.calls == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_local_search_keeps_pieces_and_capacity(lengths):
    bins = packing.best_fit(lengths, 100)
    better = packing.improve([list(b) for b in bins], lengths, 100)
    assert sorted(k for b in better for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 100 for b in better) and len(better) <= len(bins)
    squares = lambda bs: sum(sum(lengths[k] for k in b) ** 2 for b in bs)
    assert squares(better) >= squares(bins)


def test_swaps_empty_a_bin():
    lengths = [60, 30, 55, 35, 10, 10]
    assert len(packing.improve([[0, 1], [2, 3], [4, 5]], lengths, 100)) == 2
