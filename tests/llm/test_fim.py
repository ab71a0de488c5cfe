"""Fill-in-the-middle: frames, cuts, forms and digests against plain strings and SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from crawlgrain.llm import fim as M

LONG = "".join(f"line {k} é中\n" for k in range(30000)) + "end"
TEXTS = [None, "", "\n", "\n\n", "one", "a\nb", "a\nb\n", "é\n中\n\U0001f600", "has <P> mark\nx", "<S>", "a<M>", "<\nP>\nS>", "a<\n<S\nM>", LONG,
         "x" * 200_000, "y" * M.FRAME + "\n" + "z" * M.FRAME, "\n" * 70_000, "中" * 50_000, "<" * 70_000, "a\nb", "a\nb"]


def whole(text):
    to = M.Writer()
    to.add(text.encode())
    n = to.units + bool(text and not text.endswith("\n"))
    return M.Frames([dict(zip(("units", "chars", "bytes", "size", "data"), f, strict=True)) for f in to.frames], n, to.chars), n


def expected(text, doc_id, seed=M.SEED, fim=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_frames_round_trip_and_cut(text):
    stored, n = whole(text)
    raw = text.encode()
    assert b"".join(stored.stream(0, stored.size)) == raw and stored.size == len(raw)
    assert all(f["size"] <= M.FRAME for f in stored.rows)
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    for k in {0, 1, n // 3, n // 2, n - 1} - {n}:
        before = "".join(units[:k])
        assert stored.cut(k)[:2] == (len(before.encode()), len(before))
    rng = random.Random(1)
    for _ in range(5):
        a, b = sorted(rng.choices(range(len(raw) + 1), k=2))
        to = M.Writer()
        stored.copy(a, b, to)
        assert to.bytes == b - a


def test_whole_frames_are_not_compressed_anew():
    stored, n = whole(LONG)
    to, _, _ = M.rearrange(stored, n, "psm", n // 3, n // 2)
    same = {f["data"] for f in stored.rows} & {f[4] for f in to.frames}
    assert len(same) >= len(stored.rows) - 2


def test_a_cut_opens_one_frame():
    stored, n = whole(LONG)
    stored.cut(n // 2)
    assert len(stored._open) == 1


@pytest.mark.parametrize("frame", [1, 2, 3, 5, 64])
def test_marks_across_frames(monkeypatch, frame):
    monkeypatch.setattr(M, "FRAME", max(frame, 4))
    for text in ("a<\n<S\n>M>\nx", "<<P\n<<\n", "中\n<\n<\n"):
        stored, n = whole(text)
        for form in ("psm", "spm"):
            for a in range(n + 1):
                for b in range(a, n + 1):
                    to, _, _ = M.rearrange(stored, n, form, a, b)
                    made = M.Frames([dict(zip(("units", "chars", "bytes", "size", "data"), f, strict=True)) for f in to.frames])
                    assert b"".join(M.restored(made, form)) == text.encode()


def test_a_lost_mark_is_noticed():
    made, _ = whole("<P>a<S>b")
    with pytest.raises(ValueError):
        list(M.restored(made, "psm"))


@pytest.mark.parametrize("rates", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_against_strings(spark, docs_of, rates):
    docs = docs_of(*enumerate(TEXTS))
    made = M.digests(M.transform(M.store(docs), 3, *rates))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: (r.units, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in made.collect()}
    for k, text in enumerate(TEXTS):
        *row, out = expected(text, k, 3, *rates)
        assert got[k] == (*row, sha(out), sha(text or "")), k


def test_query_against_sql(spark, table):
    rows = [*enumerate(TEXTS), (5, "again\nthe id of another row\n"), (5, "a\nb"), (None, "no\nid\n"), (None, None)]
    folder = table(*rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(M.ORACLE)
    got = M.op13_fim(spark, folder)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_no_rows_and_other_columns(spark, docs_of):
    assert M.digests(M.transform(M.store(docs_of()))).collect() == []
    docs = docs_of((1, "a\nb\nc")).selectExpr("doc_id", "text", "'x' AS form", "1 AS units", "2 AS frames", "'kept' AS other", "3 AS OUTPUT")
    row = M.digests(M.transform(M.store(docs))).first()
    assert row.other == "kept" and row.units == 3 and row.form in ("psm", "spm")
