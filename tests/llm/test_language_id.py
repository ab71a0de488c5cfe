"""Held-out accuracy, odd texts, bounds of the training sample."""

import zlib

import numpy as np

from crawlgrain.llm import language_id as I

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = I.op6_language_id(spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def learnable(n=40):
    out = []
    for k in range(n):
        out += [(2 * k, "the cat sat on the mat with other things", "en"), (2 * k + 1, "der hund lief über die straße zum haus", "de")]
    return out


def test_odd_texts(spark, table):
    rows = [*learnable(), (500, None, "fr"), (501, "", "en"), (502, "123 !?", "en"), (503, "the other mat", None), (504, "THE OTHER MAT", "de"),
            (505, "Straße " * 200_000, None), (None, "der hund", "de"), (506, "the", None), (506, "the", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in I.op6_language_id(spark, table(*rows)).collect()}
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] == got[504][0] == got[506][0] == "en" and got[505][0] == got[None][0] == "de"
    assert got[503] == got[504]


def test_nothing_to_learn(spark, table):
    assert [(r.lang_pred, r.score) for r in I.op6_language_id(spark, table((2, "some text", None), (3, "more", None))).collect()] == [("und", 0.0)] * 2


def test_no_documents(spark, docs_of):
    model = I.train(docs_of(), I.remainder() != 2)
    assert model.languages == [] and I.predict(docs_of(), model).collect() == []


def test_pieces_of_long_texts_count_once(monkeypatch):
    text = "the quick brown fox über die straße " * 40
    whole = I.featurise([text])
    monkeypatch.setattr(I, "_PIECE", 37)
    parts = I.featurise([text])
    count = lambda f: np.bincount(f[0].ravel(), minlength=I.BUCKETS + 1)[: I.BUCKETS]
    assert np.array_equal(count(whole), count(parts)) and len(parts[1]) > 10 and whole[3].tolist() == parts[3].tolist()


def test_the_sample_is_bounded(spark, docs_of):
    docs = docs_of(*learnable(300))
    found = I.train(docs, I.remainder() != 2, sample=20)
    assert found.languages == ["de", "en"]
    assert found.predict(["the cat", "die straße", "?"])[0] == ["en", "de", "und"]


def test_what_the_pipeline_keeps(docs_of):
    docs = docs_of(*learnable(), (900, None), (901, "12 34"), (902, "")).selectExpr("*", "'x' AS Lang_Pred", "0.0 AS score", "1 AS __found2")
    kept = I.keep_identified(docs)
    assert kept.columns == docs.columns and {r.Lang_Pred for r in kept.collect()} == {"x"}
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80))
