"""The stages against what each must keep, on its own input and together."""

import random

import corpus_pipeline as C
import pytest

import __spark_entry__ as E
from crawlgrain.llm import bpe, decontaminate, language_id, near_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "that", "with"]) + " " + "".join(rng.choices("aeionrst", k=5)) for _ in range(n))
    item = prose(20)
    base = prose(120)
    return item, [
        (1, base), (2, base), (3, base + " more"), (4, f"{prose(30)} {item} {prose(30)}"), (5, f"{prose(40)} mail jo@ex.org today"),
        (6, None), (7, "12 34 ?"), (8, ""), *[(k, prose(60)) for k in range(20, 40)], (20, "the repeated id of a row " + prose(30))]


def test_all_stages_together(spark, table):
    item, docs = rows()
    folder = table(*docs, benchmark=[(1, item)])
    got = sorted(r.doc_id for r in C.run(spark, folder).collect())
    assert got == [1, 5, *sorted([*range(20, 40), 20])]


def test_stages_on_their_own_input(spark, table):
    item, given = rows()
    folder = table(*given, benchmark=[(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    every = ids(docs)
    lost = {"language_id": {6, 7, 8}, "near_dedup": {2, 3}, "decontaminate": {4}, "pii": set()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS and ids(out) == every - lost[name], name
    text = {r.doc_id: r.text for r in C.sanitise(spark, docs, folder).collect()}[5]
    assert "[EMAIL]" in text and "@" not in text


@pytest.mark.parametrize("stage", C.STAGES, ids=[n for n, _ in C.STAGES])
def test_no_documents(spark, table, stage):
    folder = table()
    assert stage[1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect() == []


def five_word_groups(texts):
    """id -> smallest id that links of at least 0.8 over five-word shingles reach, by comparing all pairs."""
    texts = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    cut = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in texts.items()}
    group = {i: i for i in texts}
    for i in sorted(cut):
        for j in sorted(cut):
            if i < j and cut[i] and 100 * len(cut[i] & cut[j]) >= 80 * len(cut[i] | cut[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_clean_documents_stay(spark):
    """Of the documents judged good, each stage drops only copies and contaminated ones."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    identified = {r.doc_id: r.text for r in language_id.keep_identified(docs).collect()}
    assert good <= set(identified)
    groups = five_word_groups(identified)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.find_items(docs, benchmark).collect()}
    kept = {r.doc_id for r in C.run(spark, folder).collect()}
    assert kept == {i for i, g in groups.items() if i == g and i not in leaked}


def test_registered():
    found = E.queries()
    assert [sum(name.startswith(f"op{n}_") for name in found) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in found and "pipeline" not in E.oracle_sql()
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "bpe"]
    assert C.STAGES[-1][1] is C.encode and bpe.digests


def test_clean_documents_stay_by_five_words(spark):
    """The stage's own groups decide, not those of op1."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    groups = five_word_groups({r.doc_id: r.text for r in docs.collect()})
    kept = {r.doc_id for r in near_dedup.drop_near_copies(docs).collect()}
    assert kept == {i for i, g in groups.items() if i == g}


def test_repeated_ids_in_near_dedup(spark, docs_of):
    """Equal rows stay once; a text of its own stays although another row of its id is a copy."""
    prose = lambda seed: " ".join(random.Random(seed).choices([f"w{k}" for k in range(200)], k=60))
    docs = docs_of((5, prose(1)), (5, prose(1)), (5, prose(1).upper()), (3, prose(2)), (7, prose(2)), (7, prose(3)), (None, prose(1)), (None, prose(1)),
                   (8, ""), (8, ""), (9, None))
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in near_dedup.drop_near_copies(docs).collect()), key=repr)
    assert got == sorted([(5, prose(1)), (3, prose(2)), (7, prose(3)), (None, prose(1)), (None, prose(1)), (8, ""), (8, ""), (9, "")], key=repr)
