"""Language identification and quality: held-out accuracy and odd rows."""

import numpy as np
import zlib

from memlake.llm import langid, quality


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.op2_language(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(true)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_never_sees_held_out_labels(spark):
    rows = [(i, "the cat and the dog " * 5, "en" if i % 2 else None, "x") for i in range(40)] + [(100 + i, "der hund und die katze " * 5, "de", "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    other = spark.createDataFrame([(i, t, "zz" if i in held else lang, p) for i, t, lang, p in rows], docs.schema)
    a = sorted(map(tuple, langid.op2_language(docs).collect()))
    assert a == sorted(map(tuple, langid.op2_language(other).collect()))
    assert {r[2] for r in a} == {"en", "de"}


def test_language_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, "a", "en"), (4, "a", "en"), (None, "hallo welt " * 60000, "de"), (5, "hello", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op2_language(docs).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert len(langid.op2_language(docs).collect()) == 7
    assert {tuple(r) for r in langid.op2_language(docs.where("lang is null")).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert langid.op2_language(docs.limit(0)).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {4, None, 5}


def test_long_texts_count_alike(monkeypatch):
    for text in ("Das ist ein Satz, und noch einer. " * 12000, "  a1b  ", "x", "Äß--Σς " * 9, "... .. a", "a ..   "):
        whole = np.bincount(langid.gram_hashes(text), minlength=langid.BUCKETS)
        for part in (langid._PART, 1, 2, 5):
            monkeypatch.setattr(langid, "_PART", part if len(text) < 100 or part > 5 else 9973)
            assert (langid.gram_counts(text) == whole).all(), (text[:9], part)


def test_batches_score_as_each_text_alone(monkeypatch):
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3)), np.log([0.2, 0.3, 0.5]))
    texts = ["".join(rng.choice(list("abc dé1"), rng.integers(1, 90))) for _ in range(50)] + [None, "", "12", "z" * 500]
    monkeypatch.setattr(langid, "_GRAMS", 300)
    monkeypatch.setattr(langid, "_PART", 400)
    got = model.predict(texts)
    for text, (lang, p) in zip(texts, got, strict=True):
        if not langid.has_letter(text):
            assert (lang, p) == ("und", 0.0)
            continue
        logs = model.prior + model.table[:, langid.gram_hashes(text)].sum(axis=1, dtype=float)
        e = np.exp(logs - logs.max())
        assert lang == model.langs[int(np.argmax(logs))] and abs(p - e.max() / e.sum()) < 1e-6


def test_language_clashing_columns(spark):
    rows = [(i, ("the cat and the dog ", "der hund und die katze ")[i % 2] * 3, ("en", "de")[i % 2], "x", 1.0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.op2_language(docs).collect()} == {i: ("en", "de")[i % 2] for i in range(30)}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 30


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    true = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.op1_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in true]
    assert np.mean([r["predicted"] == true[r["doc_id"]] for r in held]) > 0.9


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "!!! " * 9, 2.0), (3, "!!! " * 9, 2.0), (None, "Good text. " * 20000, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 0), (4, 1), (1, None), (None, 1)], "doc_id long, quality int")
    got = quality.op1_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = quality.op1_quality(docs, labels.limit(0)).collect()
    assert {round(r["score"], 3) for r in none} == {0.5}
    assert quality.op1_quality(docs.limit(0), labels).count() == 0


def test_isotonic():
    n, y = np.array([1.0, 2, 1, 4, 1]), np.array([1.0, 0, 1, 1, 1])
    got = quality.isotonic(n, y)
    assert (np.diff(got) >= 0).all() and np.isclose((n * got).sum(), y.sum())
    assert np.allclose(got, [1 / 3, 1 / 3, 0.4, 0.4, 1.0])


def test_statistics_read_whole_texts():
    assert len(quality.statistics("a b. C")) == len(quality.STATISTICS) == len(quality.statistics(None))
    a, b = "word " * 5000, "word " * 4999 + "%%%% "
    assert quality.statistics(a) != quality.statistics(b)
