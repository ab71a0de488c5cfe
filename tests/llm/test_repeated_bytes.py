"""Removed bytes against every 50-byte string of small documents; suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pytest
import zstandard

from crawlgrain.llm import repeated_bytes as R


def brute(rows, n=50):
    least = {}
    for i, text in rows:
        raw = (text or "").encode()
        if i is not None:
            for k in range(len(raw) - n + 1):
                least[raw[k : k + n]] = min(i, least.get(raw[k : k + n], i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - n + 1 if i is not None else 0):
            if least[raw[k : k + n]] < i:
                gone[k : k + n] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    passages = [text(rng.randint(40, 300)) for _ in range(10)]
    rows = []
    for i in range(70):
        parts = [rng.choice([text(rng.randint(0, 120)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 30):]]) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(5, rows[9][1]), (200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (202, None), (203, ""),
             (204, "a" * 400), (205, "a" * 30 + "b" + "a" * 60), (206, "\0" * 80), (207, "\0" * 90), (-4, passages[0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("split", [R.CHUNKS_A_SPLIT, 1])
def test_removal_is_that_of_all_strings(docs_of, split):
    """With 1, anchors of two chunks and more are split, so that their sorted runs have to be merged."""
    rows = sample(split)
    got = R.remove_repeats(docs_of(*rows, parts=5), chunks_a_split=split)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_one_text_in_many_chunks(docs_of):
    """A passage of every chunk: only the smallest id keeps it, also across splits."""
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=180))
    rows = [(k, "".join(rng.choices("ijklmnop ", k=90)) + passage + "".join(rng.choices("ijklmnop ", k=30))) for k in range(40, 0, -1)]
    got = R.remove_repeats(docs_of(*rows, parts=20), chunks_a_split=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_kept_bytes_and_other_columns(docs_of):
    rows = [(2, "x" + "0123456789" * 6), (1, "0123456789" * 6), (3, "short")]
    docs = docs_of(*rows).selectExpr("*", "'a' AS chunk", "'b' AS ids")
    assert {r.doc_id: bytes(r.kept_bytes) for r in R.remove_repeats(docs, with_text=True).collect()} == {
        1: b"0123456789" * 6, 2: b"x", 3: b"short"}


def test_no_documents(docs_of):
    assert R.remove_repeats(docs_of()).collect() == []


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for _ in range(300):
        raw = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abc\0") for _ in range(rng.randint(1, 150)))
        t = np.frombuffer(raw, dtype=np.uint8)
        sa = R.suffix_array(t)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        got = R.common_prefixes(t, sa, np.array([0]), np.array([len(raw)]))
        for r, i in enumerate(sa.tolist()):
            j = int(sa[r - 1])
            want = 0
            while r and want < R.LENGTH and raw[i + want : i + want + 1] == raw[j + want : j + want + 1] != b"":
                want += 1
            assert got[i] == want


def test_anchors_cover_each_window_once_and_agree():
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 101, 300).astype(np.uint8)
    a = np.concatenate((rng.integers(97, 101, 77).astype(np.uint8), shared))
    b = np.concatenate((shared, rng.integers(97, 101, 31).astype(np.uint8)))
    of = lambda t: {s: int(h) for h, x, y in zip(*R.anchors(t, np.array([len(t)])), strict=True) for s in range(x, y + 1)}
    one, two = of(a), of(b)
    assert sorted(one) == list(range(len(a) - 49)) and sorted(two) == list(range(len(b) - 49))
    assert all(one[77 + s] == two[s] for s in range(251))


def test_texts_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(R, "_PIECE", 128)
    t = np.random.default_rng(5).integers(97, 123, 1000).astype(np.uint8)
    h, first, last = R.anchors(t, np.array([400, 430, 1000]))
    starts = [s for x, y in zip(first, last, strict=True) for s in range(x, y + 1)]
    assert starts == [*range(351), *range(430, 951)]


@pytest.mark.parametrize("split", [R.CHUNKS_A_SPLIT, 1])
def test_blocks_of_many_shards(docs_of, monkeypatch, split):
    """Shards that share a block remove what shards by themselves do."""
    monkeypatch.setattr(R, "BLOCKS", 3)
    rows = sample(7)
    got = R.remove_repeats(docs_of(*rows, parts=5), chunks_a_split=split)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_a_chunk_sends_one_row_a_block_however_many_shards():
    """The number of rows between chunks and shards grew with the square of the input."""
    t = np.random.default_rng(6).integers(97, 123, 200_000).astype(np.uint8)
    ends = np.array([len(t)])
    key = np.unique(R._keys(R.anchors(t, ends)[0], 7))
    row = {"blob": zstandard.ZstdCompressor().compress(t.tobytes()), "ids": [5], "chunk": 9}
    out = R._pieces(row, ends, set(), key, np.zeros(len(key)), 7, 6144, 32, 1)
    assert len(key) > 9000 and len(out) == 192 and sum(len(r[8]) for r in out) >= len(key)
