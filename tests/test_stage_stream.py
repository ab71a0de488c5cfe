"""Keyed stage state: folds, late and silent requests, restarts, what a batch touches."""

import random

import pytest
from test_status import expected_states, random_events, states

from crawlgrain import fixed_values as V
from crawlgrain.operators import status as S
from crawlgrain.streaming import stage_fold, stages


class Stream:
    """Lands rows as files, one batch each, and runs the stream over what has landed."""

    def __init__(self, spark, folder, **options):
        self.spark, self.options = spark, options
        self.source, self.state, self.checkpoint = (f"{folder}/{d}" for d in ("in", "state", "checkpoint"))

    def land(self, rows):
        self.spark.createDataFrame(rows, stages.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, *batches):
        for rows in batches:
            self.land(rows)
        events = self.spark.readStream.schema(stages.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.source)
        query = stages.stream_stages(events, self.state, self.checkpoint, **self.options)
        query.awaitTermination()
        return query

    def status(self, now=None):
        return stages.read_status(self.spark, self.checkpoint, now)

    def changes(self, batch):
        rows = stages.read_changes(self.spark, self.state, batch).collect()
        return {r.request_id for r in rows if not r.removed}, {r.request_id for r in rows if r.removed}


def start(event_id, request, ts, stage="setup"):
    return (event_id, request, stage, "start", float(ts), "")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folds_merge_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows = random_events(seed, 200) + [(500, None, None, "start", None, None), (501, 1, None, "fail", 9.0, None), (502, 1, "x", "other", 3.0, "z")]
    parts = [[] for _ in range(5)]
    for row in rows:
        rng.choice(parts).append((row[0], row[1], row[2], row[3], row[4], row[5]))
    held = {}
    for part in parts:
        rng.shuffle(part)
        for f in stage_fold.fold_events(part):
            key = f["request_id"], f["stage_key"]
            held[key] = stage_fold.merge(held.get(key), tuple(f[n] for n, _ in stage_fold.FIELDS))
    flat = [(*key, *facts) for key, facts in held.items()]
    got = stages.as_facts(spark.createDataFrame(flat, f"request_id long, stage_key string, {stage_fold.FACTS}"))
    want = S.stage_facts(spark.createDataFrame(rows, stages.EVENT_SCHEMA))
    key = lambda df: sorted((repr(r) for r in df.select(*sorted(want.columns)).collect()))
    assert key(got) == key(want)


@pytest.mark.parametrize("seed", [4, 5])
def test_stream_equals_batch_over_random_batches_and_a_restart(spark, tmp_path, seed):
    rows = random_events(seed, 300, 12) + [(900, None, "setup", "start", 1.0, None), (901, 3, None, "start", 5.0, "d")]
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    stream = Stream(spark, tmp_path)
    for group in (parts[:3], parts[3:]):
        query = stream.run(*group)
    assert states(stream.status()) == states(S.stage_state(spark.createDataFrame(rows, stages.EVENT_SCHEMA)))
    assert query.counts() == {"seen": sum(map(len, parts[3:])), "taken": sum(map(len, parts[3:])), "removed": 0, "late": 0}


def test_a_batch_touches_only_its_requests(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    query = stream.run([start(k, k, k) for k in range(40)], [start(50, 3, 60.0, "refinement"), start(51, 77, 61.0)])
    assert stream.changes(0) == (set(range(40)), set()) and stream.changes(1) == ({3, 77}, set())
    keys = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert keys[1] <= 4 < keys[0]
    assert {f.name for f in (tmp_path / "state").iterdir()} == {"changes"}


def test_late_too_late_and_silent_requests(spark, tmp_path):
    stream = Stream(spark, tmp_path, late="5 minutes")
    query = stream.run(
        [start(1, 1, 10), start(2, 2, 100), (3, 2, "data_validation", "complete", 120.0, "")],
        [start(4, 3, 1000)],                                           # the watermark goes to 700: 1 and 2 have run out
        [start(5, 4, 800), start(6, 5, 600), start(7, 5, 10)])         # late but in time; too late, twice
    got = {r.request_id: r.n_stages for r in stream.status().collect()}
    assert got == {3: 1, 4: 1}
    assert query.counts() == {"seen": 7, "taken": 5, "removed": 2, "late": 2}
    gone = set().union(*(stream.changes(b)[1] for b in range(query.lastProgress["batchId"] + 1)))
    assert gone == {1, 2}


def test_finished_requests_go_sooner_and_a_later_stage_keeps_them(spark, tmp_path):
    stream = Stream(spark, tmp_path, late="1 second")
    done = lambda k, i, ts: [start(i, k, ts, "refinement"), (i + 1, k, "refinement", "complete", ts + 5.0, "")]
    stream.run([*done(1, 10, 1000), *done(2, 20, 1000), start(30, 9, 1010)], [start(40, 2, 1060, "setup"), start(41, 9, 1060)],
               [start(50, 9, 1080)])
    assert {r.request_id for r in stream.status().collect()} == {2, 9}   # 2 has a running stage again
    stream.run([start(60, 8, 1302)], [start(61, 8, 1303)])
    assert {r.request_id for r in stream.status().collect()} == {9, 8}


def test_a_request_begins_anew_after_its_removal(spark, tmp_path):
    stream = Stream(spark, tmp_path, late="10 seconds")
    stream.run([start(1, 1, 10)], [start(2, 2, 1000)], [start(3, 1, 1000, "refinement")])
    got = {r.request_id: (r.n_stages, r.first_started) for r in stream.status().collect()}
    assert got == {1: (1, 1000.0), 2: (1, 1000.0)}


def test_due_times_are_those_of_the_batch(spark):
    """For every request: not yet gone at its due time, gone just after."""
    rows = random_events(8, 400, 30)
    held = {}
    for f in stage_fold.fold_events(rows):
        request = held.setdefault(f["request_id"], {})
        request[f["stage_key"]] = stage_fold.merge(request.get(f["stage_key"]), tuple(f[n] for n, _ in stage_fold.FIELDS))
    status = S.stage_state(spark.createDataFrame(rows, stages.EVENT_SCHEMA)).collect()
    schema = "request_id long, status string, n_stages long, first_started double, last_ended double"
    for r in status:
        one = spark.createDataFrame([(r.request_id, r.status, r.n_stages, r.first_started, r.last_ended)], schema)
        due = stage_fold.due(held[r.request_id], tuple(V.FINAL_STAGES), V.STATUS_SECONDS, V.FINISHED_STATUS_SECONDS)
        if due is None:
            assert S.expire_status(one, 1e12).count() == 1
        else:
            assert S.expire_status(one, due).count() == 1 and S.expire_status(one, due + 0.001).count() == 0


def test_settings_of_the_session_come_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    Stream(spark, tmp_path).run([start(1, 1, 0)])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_states_of_all_events_match_the_replay(spark, tmp_path):
    rows = random_events(11, 150)
    stream = Stream(spark, tmp_path)
    stream.run(rows[:70], rows[70:])
    assert states(stream.status()) == expected_states(rows)


def test_requests_of_one_shard_share_their_state_and_go_one_by_one(spark, tmp_path):
    stream = Stream(spark, tmp_path, late="1 second", shards=1)
    query = stream.run([start(k, k, 10 * k) for k in range(30)] + [start(90, None, 3)], [start(100, 40, 400)], [start(101, 40, 400)])
    kept = {r.request_id for r in stream.status().collect()}
    assert kept == {k for k in range(30) if 10 * k + V.STATUS_SECONDS >= 399} | {40}
    assert query.counts() == {"seen": 33, "taken": 33, "removed": 11, "late": 0}
    # The state is written once a shard and batch, not once a request; the timer is another row.
    assert query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] <= 4
