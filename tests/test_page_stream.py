"""Pages let through once a lifetime: repeated rows, many batches, restarts, given entries, old folders."""

import hashlib

import pytest
from pyspark.sql import functions as F

from crawlgrain.plans.registry import QUERIES
from crawlgrain.sources.tables import PAGES_SCHEMA
from crawlgrain.streaming import pages as P

DAY = 86_400


class Stream:
    def __init__(self, spark, folder, cache=None):
        self.spark, self.folder, self.cache, self.now = spark, folder, cache, [1000.0]
        self.out = f"{folder}/out"

    def run(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        now = self.now  # the clock also runs in the tasks
        query = P.stream_analyze(stream, self.out, f"{self.folder}/checkpoint", lambda: now[0], self.cache)
        query.awaitTermination()
        return query

    def done(self):
        rows = self.spark.read.parquet(f"{self.out}/analysis").select("batch", "page_id", "url").collect()
        return sorted(map(tuple, rows), key=repr)


def page(k, url=None):
    return (k, url or f"u{k}", f"<p>{k}</p>")


def test_a_url_in_many_batches_is_analysed_once_a_lifetime(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.run([page(1), page(2)], [page(1)], [page(5, "u1"), page(3)])
    stream.now[0] += DAY - 1
    stream.run([page(1)])
    stream.now[0] += 1
    stream.run([page(1), page(2)])
    assert stream.done() == [(0, 1, "u1"), (0, 2, "u2"), (2, 3, "u3"), (4, 1, "u1"), (4, 2, "u2")]


def test_equal_rows_of_one_batch_count_once(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    rows = [page(1)] * 5 + [page(9, "u1"), (None, "u1", "<p>z</p>"), (None, "only", "<p>o</p>"), (None, "only", "<p>p</p>")]
    stream.run(rows + [(4, None, "<p>no url</p>"), (5, None, "<p>nor here</p>")])
    assert [r[1:] for r in stream.done()] == [(1, "u1"), (4, None), (5, None), (None, "only")]
    assert spark.read.parquet(f"{stream.out}/cache").count() == 4


def test_first_of_a_batch_is_chosen_before_the_shuffle():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"page_id": [7, 3, None, 2, 1], "url": ["a", "a", "a", None, None], "html": list("vwxyz")})
    (got,) = P._first_of_batch(lambda: 5)(iter([batch]))
    assert got.to_pydict() == {"page_id": [3, 2, 1], "url": ["a", None, None], "html": ["w", "y", "z"], "arrived": [5.0] * 3}


def test_given_entries_count_from_when_they_were_stored(spark, tmp_path):
    key = lambda u: hashlib.md5(u.encode()).hexdigest()
    given = [(key("u1"), "u1", 900.0, 1, True, 1, "{}"), (key("u2"), "u2", 1000.0 - DAY, 1, True, 1, "{}"), (key("u3"), "u3", 900.0, 1, False, 1, "{}")]
    stream = Stream(spark, tmp_path, spark.createDataFrame(given, P.CACHE_SCHEMA))
    stream.run([page(1), page(2), page(3), page(4)])
    assert [r[1] for r in stream.done()] == [2, 3, 4]
    stream.now[0] = 900.0 + DAY
    stream.run([page(1), page(2)])
    assert [r[:2] for r in stream.done()] == [(0, 2), (0, 3), (0, 4), (1, 1)]


def test_state_and_folders_of_old_times_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "COMPACT_EVERY", 1)
    stream = Stream(spark, tmp_path)
    stream.run([page(k) for k in range(20)])
    stream.now[0] += 4 * DAY
    stream.run([page(50)])
    query = stream.run([page(51)])
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    assert {r.url for r in spark.read.parquet(f"{stream.out}/cache").collect()} == {"u50", "u51"}
    assert not list((tmp_path / "out" / "chosen").iterdir())


@pytest.mark.parametrize("parts", [1, 3])
def test_settings_come_back(spark, tmp_path, parts):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    Stream(spark, tmp_path).run(*[[page(k)] for k in range(parts)])
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("as_folder", [False, True])
def test_the_query_reads_a_table_that_is_a_file_or_a_folder(spark, tmp_path, as_folder):
    rows = spark.createDataFrame([page(k, f"https://h{k}.org/{k}") for k in range(6)], PAGES_SCHEMA)
    rows.repartition(1 + 2 * as_folder).write.parquet(f"{tmp_path}/{'pages.parquet' if as_folder else 'made'}")
    if not as_folder:
        (file,) = (tmp_path / "made").glob("part-*")
        (tmp_path / "pages.parquet").write_bytes(file.read_bytes())
    events = [(k, k, "view", 1.0, "{}") for k in range(12)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.current_timestamp()).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["stream_page_analysis"](spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == list(range(6))
