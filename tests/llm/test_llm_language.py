from __future__ import annotations

import zlib

import numpy as np
from cases import AWKWARD, documents

from gaugeworks.llm import language
from gaugeworks.llm.base import table


def test_held_out_accuracy_and_contract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in language.op1_language_id(spark, sf_dir).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_documents(spark, sf_dir):
    model = language.train(table(spark, sf_dir, "documents"), rows=40)
    docs = documents(spark, AWKWARD)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (3, 4, 5, 6))
    assert by_id[1]["lang_pred"] == "en"
    assert language.identify(documents(spark, []), model).collect() == []


def test_without_labels_all_is_undetermined(spark):
    docs = documents(spark, AWKWARD, lang=None)
    assert language.train(docs) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.accept(docs).columns == docs.columns and language.accept(docs).count() == 0


def test_presence_counts_every_gram_of_the_whole_text(monkeypatch):
    letters = language.letter_table()
    text = "Straße, Été: " + "abc def " * 50 + "ende"
    whole = language.presence(text, letters)
    monkeypatch.setattr(language, "_CHUNK", 7)
    assert (language.presence(text, letters) == whole).all()
    clean = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
    clean = " ".join(clean.split())
    grams = [{(" " + clean + " ")[i : i + n] for i in range(len(clean) + 3 - n)} for n in range(1, 5)]
    counts = whole.reshape(language.ORDERS, -1).sum(axis=1)
    assert all(len(g) - 3 <= c <= len(g) for g, c in zip(grams, counts))


def test_landmark_features_reproduce_the_kernel():
    rng = np.random.default_rng(1)
    rows = rng.random((40, language.ORDERS * language._SIZE)) < 0.01
    labels = ["a"] * 20 + ["b"] * 20
    model = language.fit(rows, labels, landmarks=20, ridge=1e-6)
    assert [model.languages[k] for k in model.scores(rows).argmax(axis=1)] == labels


def test_accept_keeps_clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    letters = docs.filter("text rlike '[A-Za-z]'").count()
    assert language.accept(docs, 0.25).count() >= 0.99 * letters


def test_accept_drops_languages_that_were_not_learned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("length(text) > 1000")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    for out in ("de", "fr", "es"):
        hidden = [(k, t, None if name == out else name) for k, t, name in rows]
        kept = {r["doc_id"] for r in language.accept(spark.createDataFrame(hidden, "doc_id long, text string, lang string")).collect()}
        assert np.mean([k in kept for k, _, name in rows if name == out]) < 0.05
        assert np.mean([k in kept for k, _, name in rows if name != out]) > 0.99


def test_accept_judges_long_texts_and_gibberish(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()]
    clean = {name: " ".join(t for _, t, other in rows if other == name and t) for name in ("en", "de")}
    rng = np.random.default_rng(3)
    noise = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 2_000_000))
    added = [(-1, (clean["en"] * 20)[:3_000_000], None), (-2, (clean["de"] * 20)[:3_000_000], None), (-3, noise, None), (-4, noise[:3000], None), (-5, "Все люди рождаются свободными " * 40, None)]
    kept = language.accept(spark.createDataFrame(rows + added, "doc_id long, text string, lang string"))
    assert {r["doc_id"] for r in kept.filter("doc_id < 0").collect()} == {-1, -2}


def test_long_texts_with_junk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    rng = np.random.default_rng(6)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(30_000)]
    added, want = [], {}
    for name in sorted({n for _, n in rows if n}):
        words = " ".join(t for t, n in rows if n == name and t).split()
        words = (words * (1 + 200_000 // len(words)))[:180_000]
        for share in (0.0, 0.02, 0.16):
            mixed = [junk[int(rng.integers(len(junk)))] if rng.random() < share else w for w in words]
            want[len(added)] = name
            added.append((len(added), " ".join(mixed)))
    assert min(len(t) for _, t in added) > 900_000
    found = language.identify(spark.createDataFrame(added, "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == want


def test_predictions_equal_a_plain_kernel_machine(spark, sf_dir, monkeypatch):
    """The kernel as sets of grams, ridge regression in the landmarks' feature space by its dual, piece by piece."""
    monkeypatch.setattr(language, "PIECE", 500)
    docs = table(spark, sf_dir, "documents").filter("length(text) < 3000")
    picked = docs.filter(docs.lang.isNotNull() & ~language.held_out("doc_id")).collect()[:60]
    letter = language.letter_table()
    flags = np.array([language.presence(r["text"][:500], letter) for r in picked])
    labels = [r["lang"] for r in picked]
    model = language.fit(flags, labels, landmarks=8)
    sets = [set(np.flatnonzero(f)) for f in flags]
    seen: dict[str, int] = {}
    chosen = []
    for k, name in enumerate(labels):
        if seen.setdefault(name, 0) < 8:
            seen[name] += 1
            chosen.append(sets[k])
    plain = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[plain(a, b) for b in chosen] for a in chosen])
    values, vectors = np.linalg.eigh(gram)
    whiten = vectors[:, values > 1e-8 * values.max()] / np.sqrt(values[values > 1e-8 * values.max()])
    features = np.array([[plain(a, b) for b in chosen] for a in sets]) @ whiten
    names = sorted(set(labels))
    targets = np.array([[float(n == m) for m in names] for n in labels])
    centre, mean = features - features.mean(0), targets.mean(0)
    dual = np.linalg.solve(centre @ centre.T + language.RIDGE * len(sets) * np.eye(len(sets)), targets - mean)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()[:120]]
    found = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for key, text in rows:
        total, weight = np.zeros(len(names)), 0
        for start in range(0, len(text), 500):
            piece = text[start : start + 500]
            own = language.presence(piece, letter)
            if own is not None:
                value = np.array([plain(set(np.flatnonzero(own)), b) for b in chosen]) @ whiten
                total += len(piece) * ((value - features.mean(0)) @ centre.T @ dual + mean)
                weight += len(piece)
        if not weight:
            assert found[key]["lang_pred"] == "und"
            continue
        scores = np.sort(total / weight)
        assert abs(found[key]["score"] - min(1, max(0, scores[-1]))) < 1e-3
        if scores[-1] - scores[-2] > 2e-3:
            assert found[key]["lang_pred"] == names[int(np.argmax(total))]
