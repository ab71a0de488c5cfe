"""Source divergence against counts in plain Python and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from crawlgrain.llm import divergence as D

FIELDS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least, top):
    docs = [(lang or "", source or "", text or "") for lang, source, text in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, seen = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({d[:2] for d in docs})
    for lang, source, text in docs:
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        n[lang, source].update(terms)
        n[lang].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, k in seen[lang].items() if k >= least]

        def p(key, kept=kept):
            total = sum(n[key][t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[key][t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, whole = p((lang, source)), p(lang)
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            theirs = p((lang, other))
            pairs.append((-sum(abs(mine[t] - theirs[t]) for t in kept), other.encode()))
        terms = [(whole[t] - mine[t], t.encode()) for t in kept if n[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "ÄPFEL", "中文", "don't", "a1b", "x_y", "co-op", " ", "naïve", "Straße", "\U0001f600"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)]
    given = [(rng.choice(["en", "EN", "de", None]), rng.choice(["a", "b", "é", "", None, "B"]), t) for t in texts]
    return [*given, ("en", "a", None), ("fr", "none", None), ("fr", "none2", ""), ("fr", "x", "12 ."), ("en", "only", None), (None, None, None),
            ("de", "tie1", "same words"), ("de", "tie2", "same words"), ("de", "tie2", "same words")]


def frame(spark, given, parts=3):
    return spark.createDataFrame(given, "lang string, source string, text string").repartition(parts)


@pytest.mark.parametrize("least, top, cells, tile", [(1, 50, 10**6, 512), (2, 3, 40, 512), (3, 50, 20, 4), (10**6, 5, 5, 2)])
def test_against_python(spark, least, top, cells, tile):
    got = D.audit(frame(spark, rows()), least, top, cells, tile)
    assert got.columns == FIELDS
    assert sorted(map(tuple, got.collect())) == brute(rows(), least, top)


def test_query_against_sql(spark, tmp_path):
    frame(spark, rows() * 12).selectExpr("1 AS doc_id", "*", "5 AS term", "6 AS rank").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(D.ORACLE).select(", ".join(FIELDS)).fetchall()
    got = sorted(map(tuple, D.op12_divergence(spark, str(tmp_path)).collect()))
    assert got == sorted(want) and any(r[2] == "term" for r in got)


def test_no_rows(spark):
    assert D.audit(frame(spark, [], 1)).collect() == []


def test_terms_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["Aa", "bé", "c,d", "-", "x" * 40], k=3000)).encode()
    whole = D.count_terms(text)
    monkeypatch.setattr(D, "PIECE", 16)
    assert D.count_terms(text) == whole == Counter(re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower()))


def test_counters_sent_early_add_up(spark, monkeypatch):
    sums = lambda: sorted(map(tuple, D.term_cells(frame(spark, rows(), 1), 1).collect()))
    want = sums()
    held = []
    monkeypatch.setattr(D, "HELD", 3)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["a"] * 4, "text": ["x y z w", "x y z w", "q", None]})
    for sent in D._count(iter([batch, batch])):
        held += sent.to_pylist()
    total = Counter()
    for r in held:
        total[r["term"]] += r["n"]
    assert total == {"x": 4, "y": 4, "z": 4, "w": 4, "q": 2} and len(held) > 5 and want


def test_counts_beyond_a_long(spark):
    """The share of a count of 10^12 words is exact although its product is not a long."""
    n, total, terms = 10**12, 3 * 10**13, 10**6
    df = spark.createDataFrame([(n, total, terms)], "n long, t long, v long")
    assert df.select(D.share(df.n, df.t, df.v)).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_no_nested_loop(spark):
    plan = D.audit(frame(spark, rows()), 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
