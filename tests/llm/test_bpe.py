"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from crawlgrain.llm import bpe as B

TEXTS = [None, "", " \n", "It's THE don't 's 12½ ３ ﬁ", "ΟΔΟΣ Σ σς", "İstanbul é é", "<|endoftext|>a<|STARTOFTEXT|><|startoftext|>", "\0<|endoftext|>",
         "a\x1cb\x1d c\x85d\xa0e　f g", "😀👍🏽 한글 中文", "a" * 4000, "ab" * 3000, "!?" * 50, "_-_"]


def want(texts):
    whole = Tokenizer.from_file(B.default_path())
    whole.no_truncation()
    whole.no_padding()
    encoded = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    return encoded, [whole.decode(ids, skip_special_tokens=False) for ids in encoded]


def got(texts):
    bpe = B.WordBpe(B.default_path())
    ids, decoded = bpe.encode_batch(texts)
    return [np.frombuffer(i, "<i4").tolist() for i in ids], decoded


def test_given_texts():
    assert got(TEXTS) == want(TEXTS)


def test_random_texts():
    rng = random.Random(6)
    signs = list("aAbß éÉ́ΣσΑΒ 1２½'sT\x1c\x85\xa0 　İI…😀🏽,.\t\n\x0b中文한ﬁ​_") + ["<|endoftext|>", "don't", "ing", "tion"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 50))) for _ in range(3000)]
    assert got(texts) == want(texts)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(B, "WORD_ENTRIES", 3)
    monkeypatch.setattr(B, "CHUNK_ENTRIES", 3)
    bpe = B.WordBpe(B.default_path())
    ids, _ = want(TEXTS)
    for _ in range(2):
        for text, own in zip(TEXTS, ids, strict=True):
            (row,), _ = bpe.encode_batch([text])
            assert np.frombuffer(row, "<i4").tolist() == own


def test_decoding_ids():
    bpe = B.WordBpe(B.default_path())
    ids, decoded = want(TEXTS)
    assert [bpe.decode(i) for i in ids] == decoded


def test_query(spark, table):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id")]
    ids, decoded = want([t for _, t in rows])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = [(i, len(x), sha(" ".join(map(str, x))), sha(d)) for (i, _), x, d in zip(rows, ids, decoded, strict=True)]
    assert sorted((tuple(r) for r in B.op10_bpe(spark, table(*rows)).collect()), key=repr) == sorted(expected, key=repr)


def test_columns_stay(docs_of):
    docs = docs_of((1, "One two")).selectExpr("*", "1 AS IDS", "2 AS k0", "3 AS decoded")
    out = B.encode(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "k0", "n_tokens", "ids", "decoded"]
    row = out.first()
    assert row.k0 == 2 and row.n_tokens == len(row.ids) == 2 and row.decoded == "one</w> two</w>"
    assert B.encode(docs_of()).collect() == []
