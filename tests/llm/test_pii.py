"""Spans against the plain patterns, revealing terms on a made corpus, and what sanitising leaves."""

import hashlib
import random
import re

import pytest

from crawlgrain.llm import pii as P
from crawlgrain.llm.common import Scratch

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.mark.parametrize("signs", ["ab.@-", "01.9@ ", "+123 ().-4", "4111 -0", "aé@.1+-(5"])
def test_base_spans_are_the_patterns(signs):
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 30)))
        assert P.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "+1" * 200_000, "a@" * 200_000, "9." * 200_000):
        P.base_spans(text)


def corpus():
    rng = random.Random(7)
    fill = lambda n: " ".join(f"{rng.choice(['wort', 'lorem', 'ipsum', 'dolor'])}" for _ in range(n))
    rows = []
    for k in range(40):
        rows.append((k, f"{fill(12)} 4111 1111 1111 1111 {fill(12)}"))
    for k in range(40, 46):  # the name stands by one address only, each time among other words
        rows.append((k, f"{fill(6)} alpha{chr(97 + k % 26)}x Zyxwort {fill(2)} j.doe@example.org beta{chr(97 + k % 20)}y {fill(8)}"))
    rows.append((50, f"{fill(5)} zyxwort {fill(5)}"))
    rows += [(k, fill(30)) for k in range(60, 200)]
    return rows


def test_a_term_reveals_its_address(spark, docs_of):
    found = P.revealing_terms(docs_of(*corpus()), Scratch(spark, "test")).collect()
    assert [(r.term, r.entity) for r in found] == [("zyxwort", "email:j.doe@example.org")]
    assert found[0].disclosure == pytest.approx(6 / 7) and found[0].bits > P.BITS


def test_query(spark, table):
    rows = [*corpus(), (300, None), (301, ""), (302, "x@y.zz 1.2.3.4 +1 (555) 123-4567 é"), (302, "x@y.zz 1.2.3.4 +1 (555) 123-4567 é"), (None, "a@b.c")]
    got = {}
    for r in P.op4_pii(spark, table(*rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        base = plain(text or "")
        joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base)
        for r in got[i]:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            spans = r.spans.split(",") if r.spans else []
            assert [s for s in spans if not s.startswith("term")] == (joined.split(",") if joined else [])
            terms = [(m.start(), m.end()) for m in re.finditer("(?i)zyxwort", text or "")]
            assert [s for s in spans if s.startswith("term")] == [f"term:{a}:{b}" for a, b in terms]
    assert len(got[302]) == 2 and got[302][0].spans == "email:0:6,ip:7:14,phone:15:32"


def test_sanitised_texts(docs_of):
    docs = docs_of(*corpus(), (300, None), (None, "mail a@b.cd now")).selectExpr("*", "1 AS spans", "2 AS row", "3 AS base")
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert len(texts) == docs.count()
    assert "[CARD]" in texts[3].text and "4111" not in texts[3].text
    assert "[EMAIL]" in texts[41].text and "[TERM]" in texts[41].text and "[TERM]" in texts[50].text
    assert texts[300].text is None and texts[None].text == "mail [EMAIL] now" and texts[None].n_chars == 16
    assert texts[70].text == dict(corpus())[70]


def test_overlapping_spans_are_replaced_once():
    span = lambda a, k, b: {"start": a, "kind": k, "stop": b}
    assert P.replace_spans("abcdefgh", [span(1, 0, 4), span(2, 2, 6), span(7, 5, 8)]) == "a[EMAIL]g"


def test_no_documents(spark, table):
    assert P.op4_pii(spark, table()).collect() == []


@pytest.mark.parametrize("name", ["Li", "Kim", "李明"])
def test_short_names_reveal_their_address(spark, docs_of, name):
    rows = [(k, t.replace("Zyxwort", name).replace("zyxwort", name)) for k, t in corpus()]
    found = P.revealing_terms(docs_of(*rows), Scratch(spark, "test")).collect()
    assert [(r.term, r.entity) for r in found] == [(name.lower(), "email:j.doe@example.org")]


def test_near_words_are_counted_whatever_their_length():
    rng = random.Random(4)
    for _ in range(300):
        before, after = (["".join(rng.choices("abcdé", k=rng.choice([1, 3, 90, 700]))) for _ in range(rng.randint(0, 12))] for _ in "ab")
        left, right = " ".join(before), "\n".join(after)
        text = f"{left} a@b.cc {right}"
        start = len(left) + 1
        assert P._terms_around(text, start, start + 6) == before[-8:] + after[:8]
