"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cases import AWKWARD, documents
from gaugeworks.llm import packing
from gaugeworks.llm.base import table
from test_llm_decontam import brute
from test_llm_nearcopies import plain_first
from test_llm_spans import plain_secrets


def plain_redacted(text):
    out, at = "", 0
    for kind, start, end in plain_secrets(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_run_equals_plain_stages(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    docs = [(k, t) for k, t in docs if t and re.search(r"[^\W\d_]", t)]
    docs = plain_first(docs)
    dirty = {k for k, *_ in brute(docs, items)}
    docs = [(k, plain_redacted(t)) for k, t in docs if k not in dirty]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for key, text in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            want.append((key, n, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_stages_keep_the_columns_and_take_awkward_rows(spark, sf_dir):
    docs = documents(spark, AWKWARD)
    for rows in (docs, docs.limit(0)):
        kept = rows
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, sf_dir)
            if name != "packing":
                assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        kept = kept.collect()
    assert kept == []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "packing"]
