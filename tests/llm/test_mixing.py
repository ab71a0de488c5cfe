"""Mixing: permutations, targets, draws, blocks and the mix itself against plain Python."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from crawlgrain.llm import mixing as M
from crawlgrain.llm.common import Scratch


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "", "B", "tiny", "big"]
    rows = []
    for k in range(n):
        source = rng.choice(names[:6])
        rows.append((k, " ".join(f"{k}.{j}" for j in range(rng.choice([0, 1, 3, 40, 333]))), source))
    rows += [(100, "one", "tiny"), (101, None, "wordless"), (102, " \t\n", "wordless"), (103, "x" * 500, "big"), (104, "  no\x0bbreak", "a"),
             (None, "without an id", "a"), (None, None, None), (5, "again the id", "b"), (5, "again the id", "b"), (6, None, "b")]
    return rows + [(200 + k, " ".join(["w"] * 700), "big") for k in range(10)]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.repartition(parts) if rows else df


def targets(sizes):
    """Water-filling by the contract's own words, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    done = dict.fromkeys(names, Fraction(0))
    rest, open_ = Fraction(sum(sizes.values())), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return done | share
        for s in above:
            done[s] = Fraction(3 * sizes[s])
            rest -= done[s]
        open_ -= above


@pytest.mark.parametrize("size", [150_000_000, 3_000_000_000])
def test_targets_of_many_words(spark, size):
    """Weight times words is above 2^31 from 430 million words on."""
    sizes = {"a": size, "b": size + 1, "c": 7, "d": 2 * size}
    rows = [(s, k, M.WEIGHTS[k % 3], n, 0) for k, (s, n) in enumerate(sizes.items())]
    got = M.plan(spark.createDataFrame(rows, "source string, src long, weight int, size long, base long")).collect()
    want = targets(sizes)
    assert {r.source: r.target for r in got} == pytest.approx({s: float(t) for s, t in want.items()})
    for r in got:
        take = min(int(want[r.source] + Fraction(1, 2)), 3 * r["size"])
        assert r.blocks == -(-r["size"] // 512)
        assert r.quota == take // r["size"] * r.blocks + -(-(take % r["size"]) // 512)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutations(n):
    i = np.arange(n)
    one, two = (M.permuted(i, np.full(n, n), np.full(n, key)) for key in (5, -6))
    assert sorted(one) == sorted(two) == list(range(n))
    assert n < 16 or one.tolist() != two.tolist()


def test_permutation_of_large_domains():
    n = np.array([10**12, 3, 1 << 40, 7])
    got = M.permuted(np.array([5, 2, 9, 6]), n, np.arange(4))
    assert ((got >= 0) & (got < n)).all()


@pytest.mark.parametrize("block, shard, fan", [(512, 2048, 1024), (4, 7, 2), (1, 50, 3), (64, 5, 3)])
def test_mix(spark, block, shard, fan):
    rows = corpus()
    mix = M.Mix(frame(spark, rows), block, shard, fan_out=fan)
    words = lambda t: (t or "").encode().split()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = targets(sizes)

    planned = {r.source: r for r in mix.sources.collect()}
    assert set(planned) == set(sizes)
    for s, r in planned.items():
        assert r.target == pytest.approx(float(want[s])) and r["size"] == sizes[s]

    report = mix.report().collect()
    key = lambda rs: Counter((r.doc_id, r["size"], r.source_size) for r in rs)
    assert key(report) == Counter((i, len(words(t)), sizes[s]) for i, t, s in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in report)

    held, taken, places = mix.rows().collect(), Counter(), defaultdict(set)
    texts = {(s, t) for _, t, s in rows}
    for r in held:
        taken[r.src] += r.words
        places[r.shard].add(r.place)
        assert 0 < r.words <= block
    assert {planned[s].src: taken[planned[s].src] for s in planned} == {
        planned[s].src: min(int(want[s] + Fraction(1, 2)), 3 * sizes[s]) for s in planned}
    assert sum(r.taken for r in report) == sum(taken.values())
    # Every place of every shard is filled once, in blocks that are whole but for the last of a source.
    slots = sum(r.quota for r in planned.values())
    assert {s: len(p) for s, p in places.items()} == {s: min(shard, slots - s * shard) for s in places}
    assert max(places) == -(-slots // shard) - 1 and all(p == set(range(len(p))) for p in places.values())
    by_text = {(i, s): t for i, t, s in rows if i is not None}
    names = {r.src: s for s, r in planned.items()}
    for r in held:
        if r.doc_id is not None and r.doc_id not in (5, 6):
            assert words(by_text[r.doc_id, names[r.src]])[r.first : r.first + r.words] == words(r.text)[: r.words]
    assert texts


def test_slots_are_not_broadcast(spark):
    slots = spark.createDataFrame([(0, 0, 0, 0, 2), (0, 1, 0, 0, 1)], "shard long, place long, src long, block long, words int")
    pieces = spark.createDataFrame([(0, 0, 0, 2, 7, 0, 0, "a b"), (0, 1, 0, 2, 7, 0, 2, "c d")],
                                   "src long, block long, at int, words int, doc_id long, before_size long, first long, text string")
    met = M.join_blocks(slots, pieces)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.place, r.words, r.text) for r in met.collect()) == [(0, 2, "a b"), (1, 1, "a b")]


def test_reruns_agree_whatever_the_partitions(spark):
    one, two = (M.Mix(frame(spark, corpus(), parts), 8, 16) for parts in (1, 7))
    key = lambda m: sorted(map(tuple, m.rows().collect()), key=repr)
    assert key(one) == key(two)
    assert key(one) != key(M.Mix(frame(spark, corpus()), 8, 16, seed=12))


def test_draws_are_multinomial_per_shard(spark):
    """Shares of a shard scatter about the quotas' shares, and shards differ."""
    planned = spark.createDataFrame([(0, 600), (1, 300), (2, 100), (3, 0)], "src long, quota long")
    for fan in (2, 1024):
        got = M.draw(planned, 100_000, 1000, 1, fan).collect()
        by = defaultdict(Counter)
        for r in got:
            by[r.shard][r.src] += r.n
        assert len(by) == 100 and all(sum(c.values()) == 1000 for c in by.values()) and all(c[3] == 0 for c in by.values())
        first = np.array([c[0] for c in by.values()])
        assert abs(first.mean() - 600) < 6 and 8 < first.std() < 25


def test_written_mix(spark, tmp_path):
    mix = M.Mix(frame(spark, corpus()), 16, 8)
    mix.write(str(tmp_path / "mix"))
    rows = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert all(len(r.text.encode().split()) == r.words for r in rows)
    assert Counter((r.shard, r.place, r.at) for r in rows) == Counter((r.shard, r.place, r.at) for r in mix.rows().collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", None)], [(1, "one", None)]])
def test_hardly_any_rows(spark, rows):
    got = M.Mix(frame(spark, rows, 1)).report().collect()
    words = [len((t or "").split()) for _, t, _ in rows]
    assert sorted(r["size"] for r in got) == sorted(words) and sorted(r.taken for r in got) == sorted(words)


def test_long_text_and_other_columns(spark, monkeypatch, tmp_path):
    rows = [(1, "ab \t" * 3000, "a"), (2, "c " * 100, "b")]
    frame(spark, rows).selectExpr("*", "1 AS size", "2 AS src", "3 AS block", "4 AS before_size", "5 AS part").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in M.op11_mixing(spark, str(tmp_path)).collect()}
    assert got[1]["size"] == 3000 and got[2]["size"] == 100 and got[2].taken == 300 and got[1].taken == 2800
    monkeypatch.setattr(M, "_PIECE", 10)
    assert [w for p in M._word_pieces(rows[0][1].encode()) for w in p] == rows[0][1].encode().split()


def test_running_sums_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 50), rng.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(4)
    got = M._running(df, ["k", "n"], ["n"], Scratch(spark, "test"), "x").collect()
    done, want = 0, []
    for k, n in sorted(rows):
        want.append((k, n, done))
        done += n
    assert sorted(map(tuple, got)) == sorted(want)
