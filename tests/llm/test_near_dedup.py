"""Near-duplicate groups against a comparison of all pairs of shingle sets."""

import random

import numpy as np
import pytest

from crawlgrain.llm import near_dedup as N


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                u, v = find(a), find(b)
                label[max(u, v)] = min(u, v)
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in sets), key=repr)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words)


def sample(seed=5):
    rng = random.Random(seed)
    rows, number = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3, 6, 9, 30, 120, 400]))]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06):
            rows.append((number, edited(rng, words, share)))
            number += 1
    base = [f"h{k}" for k in range(200)]
    rows += [(number + k, edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.06]))) for k in range(60)]
    rng.shuffle(rows)
    return rows


def test_groups_are_those_of_all_pairs(docs_of):
    rows = sample()
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "ONE"), (904, "one"), (905, "one  two"), (906, "One\ntwo"), (907, "Ä"), (908, "ä")]
    got = sorted((tuple(r) for r in N.near_groups(docs_of(*rows)).collect()), key=repr)
    assert got == brute(rows)


def test_a_hub_that_is_neither_first_nor_last(docs_of):
    """Copies at 0.9 of a base in the middle of the ids, most of them below 0.85 of each other."""
    rng = random.Random(8)
    base = [f"h{k}" for k in range(300)]
    rows = [(k, edited(rng, base, 0.014) if k != 40 else " ".join(base)) for k in range(80)]
    got = sorted((tuple(r) for r in N.near_groups(docs_of(*rows)).collect()), key=repr)
    assert got == brute(rows) and len({r[2] for r in got}) < 40


def test_empty_table_repeated_and_null_ids(docs_of):
    assert N.near_groups(docs_of()).collect() == []
    text = " ".join(map(str, range(50)))
    got = {(r.doc_id, r.component_id, r.kept) for r in N.near_groups(docs_of((4, text), (4, text), (9, text), (None, "lone words here"))).collect()}
    assert got == {(4, 4, True), (9, 4, False), (None, None, True)}


def test_one_document_of_each_group_stays(docs_of):
    text = " ".join(map(str, range(400)))
    docs = docs_of((7, text), (3, text.replace(" 200 ", " x ")), (5, None), (6, "")).selectExpr("*", "1 AS node", "2 AS `key`", "3 AS component_id")
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6]


@pytest.mark.parametrize("share", [0.5, 0.85, 0.95])
def test_estimates_are_near_the_truth(share):
    rng = np.random.default_rng(3)
    a, b = [], []
    for _ in range(200):
        both, own = int(600 * share), 600 - int(600 * share)
        x = rng.integers(1, 2**63, 600 + own, dtype=np.uint64)
        a.append(np.unique(x[:600]))
        b.append(np.unique(x[-600:] if own else x[:600]))
        assert len(np.intersect1d(a[-1], b[-1])) == both
    truth = int(600 * share) / (1200 - int(600 * share))
    found = N.estimate(N.sketches(a), N.sketches(b))
    assert abs(found.mean() - truth) < 0.01
    assert np.abs(found - truth).max() < 0.2


def test_components_of_a_long_chain(spark, docs_of):
    from crawlgrain.llm.common import Scratch

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 105)], "a long, b long")
    got = {r.node: r.label for r in N.components(links, Scratch(spark, "test"), "chain").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 105: 100}


def brute_stage(rows, words=5, least=80):
    """Ids that stay: the smallest of each component over links of ``words``-word shingles."""
    cut = lambda w: {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    sets = [(i, cut((t or "").encode().lower().split())) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= least * len(x | y):
                u, v = find(a), find(b)
                label[max(u, v)] = min(u, v)
    return sorted(i for i in label if find(i) == i)


def test_the_stage_links_five_words_at_four_fifths(docs_of):
    """Copies that differ by one block are linked at five words and 0.8, though not at three words and 0.85."""
    rows = [(i, t) for i, t in sample(11) if i < 500]
    base = [f"q{k}" for k in range(100)]
    rows += [(500, " ".join(base)), (501, " ".join([*base, *(f"z{k}" for k in range(20))])), (502, " ".join(base[:60])),
             (503, "one two three"), (504, "ONE two three"), (505, "one two three four"), (506, None), (507, "")]
    stays = [r.doc_id for r in N.drop_near_copies(docs_of(*rows)).collect()]
    assert sorted(stays) == brute_stage(rows)
    assert 500 in stays and 501 not in stays
    assert {501} <= {r.doc_id for r in N.near_groups(docs_of(*rows)).collect() if r.kept}
