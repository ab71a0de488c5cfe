"""Token-id files: ids as the library gives them, exact round trips, damage, starts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from crawlgrain.llm import token_files as T

TEXTS = [None, "", " ", "a", "don't stop", "  two  spaces ", "line\n\n next\tone", "nb sp 　x", "<|endoftext|> in text", "é é 中文",
         "x" * 5000, "word " * 3000]


@pytest.mark.parametrize("n", [1, 2, 4095, 4096, 4097, 20000])
@pytest.mark.parametrize("kinds", [1, 3, 5000])
def test_blocks_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.integers(0, kinds, n), rng.integers(0, kinds, n)).astype("<u4")
    half = n // 3
    back, got = T.unpack_file(T.pack_file([5, None, -3], [ids[:half].tobytes(), b"", ids[half:].tobytes()]))
    assert back == [5, None, -3]
    assert [g.tolist() for g in got] == [ids[:half].tolist(), [], ids[half:].tolist()]


def test_repetition_is_compressed():
    ids = np.tile(np.arange(50), 2000).astype("<u4")
    assert len(T.pack_file([1], [ids.tobytes()])) < len(ids) / 4


def test_blocks_are_independent():
    """A block's words depend on its own ids and the file's frequencies alone."""
    rng = np.random.default_rng(1)
    one, two, three = (rng.integers(0, 300, T.BLOCK) for _ in range(3))
    _, freq = T._frequencies(np.arange(300))
    a = T.encode_blocks(np.concatenate((one, two)), freq)
    b = T.encode_blocks(np.concatenate((three, two)), freq)
    assert a[1].tolist() == b[1].tolist() and a[0].tolist() != b[0].tolist()


@pytest.mark.parametrize("at", [2, 30, 60, -1, -400])
def test_damage_is_noticed(at):
    ids = np.random.default_rng(2).integers(0, 900, 9000).astype("<u4")
    data = bytearray(T.pack_file([1], [ids.tobytes()]))
    data[at] ^= 255
    with pytest.raises((ValueError, zlib.error)):
        T.unpack_file(bytes(data))


def test_pieces_give_the_library_s_ids():
    rng = random.Random(4)
    signs = list("ab1 .'\n\t  é中　\x1c<|>") + ["<|endoftext|>", "  ", " a", " \n", "don't"]
    texts = TEXTS + ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)]
    whole = Tokenizer.from_file(T.default_path())
    want = [whole.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in T.Encoder(T.default_path()).encode(texts)] == want


def test_plain_pieces_are_merged_without_the_pattern():
    """Cutting by the pattern takes most of the library's time; only heads and odd pieces still need it."""
    e, cut = T.Encoder(T.default_path()), []
    ids = e._ids
    e._ids = lambda pieces: cut.extend(pieces) or ids(pieces)
    text = "alpha beta, gamma.\nDelta don't élan 12 x-y 3rd $5.00 中文 beta."
    whole = Tokenizer.from_file(T.default_path())
    want = [whole.encode(text, add_special_tokens=False).ids + [0]] * 2
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([text, text])] == want
    assert cut == ["alpha", " don't", " 中文"]


def test_pieces_outlive_a_task():
    """Between tasks the first pieces stay, and ids are the same with any table."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé1.,\n-", k=rng.randint(1, 9))) for _ in range(2000)] + ["w" * 150 + ".", "w" * 150]
    batches = [[" ".join(rng.choices(words, k=300)) for _ in range(4)] for _ in range(6)]
    whole = Tokenizer.from_file(T.default_path())
    e = T.Encoder(T.default_path())
    for k, batch in enumerate(batches):
        want = [whole.encode(t, add_special_tokens=False).ids + [0] for t in batch]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(batch)] == want
        before = len(e.known)
        e.forget(100 if k % 2 else 10_000)
        assert len(e.known) == before if k % 2 == 0 else 90 < len(e.known) <= 100
    e.forget()
    assert not e.known and e.encode([None, ""]) == [bytes(4)] * 2


def test_every_number_of_symbols():
    """As many distinct ids as the coder can tell apart, and ids too large to be counted in a table."""
    ids = np.random.default_rng(6).permutation(np.arange(1 << 16)).astype("<u4")
    for own in (ids, ids + np.uint32(1 << 31)):
        _, (got,) = T.unpack_file(T.pack_file([1], [own.tobytes()]))
        assert got.tolist() == own.tolist()


def test_query_reads_the_files_in_order(spark, table):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again three"), (50, TEXTS[-1])]
    got = [tuple(r) for r in T.op2_token_files(spark, table(*rows)).collect()]
    whole = Tokenizer.from_file(T.default_path())
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_small_files_and_no_documents(spark, docs_of, tmp_path):
    folder = str(tmp_path / "ids")
    docs = docs_of(*[(k, f"text number {k} " * 20) for k in range(30)])
    manifest = T.write_token_files(docs, folder, file_ids=200).collect()
    assert len(manifest) > 5 and sum(r.docs for r in manifest) == 30
    got = sorted(T.read_token_files(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(30))
    assert [r.start for r in got][1:] == [r.start + r.n_tokens for r in got][:-1]
    assert T.read_token_files(spark, folder, T.write_token_files(docs_of(), folder).collect()).collect() == []
