"""The cache as a table of deltas: what an upsert writes, what readers see, expiry by folders, joins without moving pages."""

import random
import time

import pytest

from crawlgrain.operators import cache as C
from crawlgrain.operators.cache_store import CACHE_COLUMNS, Conflict, CacheStore, bucket_pages
from crawlgrain.plans import analysis as A

DAY = 86_400


def entry(url, at, version=1, readable=True, analysis="{}"):
    import hashlib
    return (hashlib.md5(url.encode()).hexdigest(), url, at, 5, readable, version, analysis)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CACHE_COLUMNS)


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("data-*/**/*.parquet")}


def shown(df):
    return sorted(((r.url, r.cache_time, r.version, r.analysis) for r in df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return CacheStore(spark, str(tmp_path / "cache"), buckets=4, part_seconds=DAY // 8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_upsert_writes_only_its_buckets(spark, store, tmp_path):
    store.upsert(frame(spark, *[entry(f"u{k}", 1000.0) for k in range(200)]))
    before = files(tmp_path)
    store.upsert(frame(spark, entry("u7", 2000.0, 2, analysis="new")))
    after = files(tmp_path)
    assert {k: after[k] for k in before} == before and len(after) == len(before) + 1
    got = {r.url: r.analysis for r in store.read().collect()}
    assert len(got) == 200 and got["u7"] == "new"


@pytest.mark.parametrize("seed", [1, 2])
def test_the_newest_entry_of_each_key_as_the_table_form_gives_it(spark, store, seed):
    rng = random.Random(seed)
    batches = [[entry(f"u{rng.randrange(12)}", rng.choice([None, 0.0, 500.0, 90_000.0, 95_000.0, 100_000.0]), k * 100 + j, rng.random() < 0.8, f"{k}.{j}")
                for j in range(30)] for k in range(3)]
    for rows in batches:
        store.upsert(frame(spark, *rows))
    every = frame(spark, *[r for rows in batches for r in rows])
    assert shown(store.read()) == shown(C.latest_per_key(every))
    for now in (100_000.0, 150_000.0, 190_000.0):
        assert shown(store.fresh(now)) == shown(C.fresh_cache(every, now))
    assert store.compact(100_000.0)
    assert shown(store.fresh(100_000.0)) == shown(C.fresh_cache(every, 100_000.0))


def test_ties_and_repeated_entries_give_one_row(spark, store):
    same = entry("u", 5.0)
    store.upsert(frame(spark, same, same))
    store.upsert(frame(spark, same))
    assert store.read().count() == 1


def test_a_reader_during_a_write_sees_one_version(spark, store):
    store.upsert(frame(spark, *[entry(f"u{k}", 10.0) for k in range(9)]))
    held = store.read()
    store._append(frame(spark, entry("u1", 20.0, analysis="half"), entry("new", 20.0)), 0, 2)  # written, not yet in a manifest
    assert held.count() == 9 and {r.analysis for r in store.read().collect()} == {"{}"}
    store.upsert(frame(spark, entry("u2", 30.0, analysis="whole")))
    assert sorted(r.analysis for r in store.read().collect()) == ["whole"] + ["{}"] * 8
    assert {r.analysis for r in held.collect()} == {"{}"}                                 # the older reader keeps its manifest


def test_writers_at_once(spark, store, monkeypatch):
    other = CacheStore(spark, store.root, buckets=4)
    append = CacheStore._append

    def slow(self, *args):
        made = append(self, *args)
        if self is store and not slow.done:
            slow.done = True
            other.upsert(frame(spark, entry("theirs", 1.0)))
            if slow.compacts:
                other.compact(2.0)
        return made

    for compacts in (False, True):
        slow.done, slow.compacts = False, compacts
        monkeypatch.setattr(CacheStore, "_append", slow)
        store.upsert(frame(spark, entry(f"ours{compacts}", 1.0)))
        monkeypatch.setattr(CacheStore, "_append", append)
    assert {r.url for r in store.read().collect()} == {"theirs", "oursFalse", "oursTrue"}


def test_a_compaction_gives_way(spark, store, monkeypatch):
    store.upsert(frame(spark, entry("a", 1.0)))
    append = CacheStore._append

    def raced(self, entries, generation, version):
        made = append(self, entries, generation, version)
        if generation == 1:
            monkeypatch.setattr(CacheStore, "_append", append)
            CacheStore(spark, store.root, buckets=4).upsert(frame(spark, entry("b", 1.0)))
        return made

    monkeypatch.setattr(CacheStore, "_append", raced)
    assert store.compact(2.0) is False
    assert {r.url for r in store.read().collect()} == {"a", "b"} and store.manifest()["generation"] == 0
    with pytest.raises(Conflict):
        store._put({"version": 1, "generation": 0, "commits": []})


def test_expiry_drops_whole_folders_and_reads_no_live_file(spark, store, tmp_path):
    store.upsert(frame(spark, *[entry(f"u{k}", k * 5000.0) for k in range(40)], entry("timeless", None)))
    live = {f for f in files(tmp_path) if int(f.split("part=")[1].split("/")[0]) >= (190_000 - DAY) // 10_800}
    for f in live:
        open(f, "r+b").truncate(4)                       # whoever read one of these would fail
    dead = [k for k in range(40) if (k * 5000 // 10_800 + 1) * 10_800 <= 190_000 - DAY]
    assert store.expire(190_000.0) == len(dead) + 1
    assert set(files(tmp_path)) == live and len(live) < 40
    assert store.expire(190_000.0) == 0


def test_compaction_keeps_live_entries_and_moves_none(spark, store, tmp_path):
    for k in range(4):
        store.upsert(frame(spark, *[entry(f"u{j}", 100_000.0 + k, k, analysis=f"{k}") for j in range(20)], entry(f"old{k}", 5.0)))
    store.upsert(frame(spark, entry("u3", 100_009.0, 9, readable=False)))
    assert "hashpartitioning" not in plan(store._newest(store._rows(store.manifest())).repartition(4, "cache_key"))
    assert store.compact(100_010.0)
    got = store.read().collect()
    assert {r.url for r in got} == {f"u{j}" for j in range(20) if j != 3} and {r.analysis for r in got} == {"3"}
    assert store.manifest()["commits"] and len(store.manifest()["commits"]) == 1


def test_maintenance_compacts_after_many_commits(spark, store, monkeypatch):
    import crawlgrain.operators.cache_store as S
    monkeypatch.setattr(S, "COMPACT_AFTER", 3)
    for k in range(3):
        store.upsert(frame(spark, entry(f"u{k}", 100_000.0)))
        store.tidy(100_000.0)
    assert store.manifest()["generation"] == 1 and store.read().count() == 3


def test_one_url_reads_one_bucket(spark, store):
    store.upsert(frame(spark, *[entry(f"u{k}", 10.0) for k in range(50)]))
    found = store.entries("u7")
    assert [r.url for r in found.collect()] == ["u7"]
    assert "SelectedBucketsCount: 1 out of 4" in found._jdf.queryExecution().explainString(
        spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_an_empty_store(spark, store):
    assert store.read().count() == 0 and store.fresh(5.0).count() == 0 and store.expire(5.0) == 0
    store.upsert(frame(spark))
    assert store.read().count() == 0 and store.compact(5.0) and store.read().count() == 0


def test_incremental_analysis_of_bucketed_pages_moves_no_html(spark, store, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>page {k}</p>") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    store.upsert(frame(spark, *[entry(f"http://h/{k}", 1000.0, analysis=f"kept {k}") for k in range(10)]))
    name = f"bucketed_{time.time_ns()}"
    bucketed = bucket_pages(pages, name, str(tmp_path / "pages"), 4)
    found = A.analyze_incremental(bucketed, store, 2000.0)
    got = found.collect()
    assert "Exchange" not in plan(found) and "SortMergeJoin" not in plan(found)
    assert sorted(r.page_id for r in got if r.origin == "cache") == list(range(10))
    assert {r.analysis for r in got if r.origin == "cache"} == {f"kept {k}" for k in range(10)}
    table_form = A.analyze_incremental(pages, store.read(), 2000.0)
    assert sorted(map(tuple, got)) == sorted(map(tuple, table_form.collect()))


def test_the_maintenance_stream_tidies_the_store(spark, store, tmp_path):
    from crawlgrain.streaming.maintenance import stream_tidy
    store.upsert(frame(spark, entry("dead", 5.0), entry("live", 200_000.0)))
    query = stream_tidy(spark, store, lambda: 200_000.0, str(tmp_path / "c"), "1 second")
    try:
        for _ in range(60):
            if query.lastProgress:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert store.parts() == [200_000 // 10_800] and {r.url for r in store.read().collect()} == {"live"}
