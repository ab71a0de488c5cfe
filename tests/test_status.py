"""Stage status: batch and stream against a plain event-by-event loop."""

import random

import pytest

from crawlgrain import fixed_values as V
from crawlgrain.operators import status as S
from crawlgrain.streaming import maintenance, stages

STAGES = [*V.STAGES, "website_analysis"]


def random_events(seed, n=600, requests=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        request = 0 if rng.random() < 0.5 else rng.randrange(1, requests)
        action = rng.choice(["start", "start", "complete", "fail"])
        rows.append((i, request, rng.choice(STAGES), action, float(i * 7), rng.choice(["", "note", f"d{i}"])))
    return rows


def replay(rows):
    """One event after the other, as a mutable status per request."""
    store = {}
    for _, request, stage, action, ts, details in rows:
        st = store.setdefault(request, {"status": "initializing", "current": None, "progress": 0.0, "stages": [],
                                        "message": "Request initialized", "error": None})
        if action == "start":
            st["stages"].append({"stage": stage, "start": ts, "end": None, "status": "in_progress", "details": details})
            st["current"] = stage
            if stage in V.STAGES:
                st["progress"] = min(95.0, V.STAGES.index(stage) / len(V.STAGES) * 100)
            continue
        entry = next((s for s in st["stages"] if s["stage"] == stage), None)
        if entry is None:
            continue
        entry["end"] = ts
        entry["status"] = "completed" if action == "complete" else "failed"
        if action == "fail" or details:
            entry["details"] = details
        if action == "fail":
            st.update(status="failed", error=details, message=f"Failed during {stage}: {details}")
        elif stage in V.FINAL_STAGES:
            st.update(status="completed", progress=100.0, message="Processing completed")
    return store


def expected_states(rows):
    return {k: (s["status"], s["current"], round(s["progress"], 6), len(s["stages"]), s["message"], s["error"],
                s["stages"][0]["start"] if s["stages"] else None, s["stages"][-1]["end"] if s["stages"] else None)
            for k, s in replay(rows).items()}


def states(df):
    return {r.request_id: (r.status, r.current_stage, round(r.progress, 6), r.n_stages, r.message, r.error,
                           r.first_started, r.last_ended) for r in df.collect()}


@pytest.mark.parametrize("seed, n", [(1, 600), (2, 40), (3, 12)])
def test_batch_equals_replay(spark, seed, n):
    rows = random_events(seed, n)
    df = spark.createDataFrame(rows, stages.EVENT_SCHEMA)
    assert states(S.stage_state(df)) == expected_states(rows)


def test_stage_entries_equal_replay(spark):
    rows = random_events(5)
    got = S.stage_entries(spark.createDataFrame(rows, stages.EVENT_SCHEMA)).orderBy("request_id", "event_id").collect()
    want = [(k, s["stage"], s["start"], s["end"], s["status"], s["details"])
            for k, st in sorted(replay(rows).items()) for s in st["stages"]]
    assert [(r.request_id, r.stage, r.start_time, r.end_time, r.status, r.details) for r in got] == want


def test_stream_equals_replay_over_many_batches(spark, tmp_path):
    rows = random_events(9)
    source, state, checkpoint = (str(tmp_path / d) for d in ("in", "state", "checkpoint"))

    def add(part):
        spark.createDataFrame(part, stages.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(stages.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = stages.stream_stages(stream, state, checkpoint)
        query.awaitTermination()
        return query

    add(rows[:100])
    add(rows[100:250])
    first = run()
    assert states(stages.stored_status(spark, first, state)) == expected_states(rows[:250])
    add(rows[250:])                                                 # a restart continues from the stored facts
    assert states(stages.stored_status(spark, run(), state)) == expected_states(rows)


def test_stream_drops_expired_requests(spark, tmp_path):
    rows = [(1, 1, "setup", "start", 0.0, ""), (2, 2, "setup", "start", 500.0, "")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, stages.EVENT_SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(stages.EVENT_SCHEMA).parquet(source)
    query = stages.stream_stages(stream, str(tmp_path / "s"), str(tmp_path / "c"), now=lambda batch: 600.0)
    query.awaitTermination()
    assert set(states(stages.stored_status(spark, query, str(tmp_path / "s")))) == {2}


STATUS = "request_id int, status string, n_stages long, first_started double, last_ended double"


def test_status_lifetimes(spark):
    now = 1000.0
    rows = [(1, "in_progress", 1, now - 300, None), (2, "in_progress", 1, now - 301, None), (3, "initializing", 0, None, None),
            (4, "completed", 1, now - 100, now - 60), (5, "failed", 1, now - 100, now - 61), (6, "failed", 2, now - 100, None)]
    kept = S.expire_status(spark.createDataFrame(rows, STATUS), now)
    assert sorted(r.request_id for r in kept.collect()) == [1, 3, 4, 6]
    assert S.expire_status(kept, now).count() == 4


def test_unknown_ids_give_null_rows(spark):
    updates = spark.createDataFrame([(1, 7, "a", None), (2, 7, None, "x"), (3, 7, "b", None)],
                                    "event_id long, request_id long, status string, message string")
    ids = spark.createDataFrame([(7,), (8,)], "request_id long")
    got = S.latest_status(updates, ["status", "message"], ids).orderBy("request_id").collect()
    assert [tuple(r) for r in got] == [(7, "b", "x"), (8, None, None)]


def test_maintenance_periods(spark, tmp_path):
    assert [maintenance.cache_due(t, last) for t, last in ((5.0, None), (599.0, 0.0), (600.0, 0.0), (725.0, 0.0))] == [True, False, True, True]
    schema = "cache_key string, url string, cache_time double, size_bytes long, readable boolean, version long"
    old = spark.createDataFrame([("k", "u", 0.0, 1, True, 1)], schema)
    status = spark.createDataFrame([(1, "failed", 1, 0.0, 0.0)], STATUS)
    assert [df.count() for df in maintenance.maintain(status, old, 600_000.0, 599_000.0)] == [0, 0]
    assert [df.count() for df in maintenance.maintain(status, old, 600_060.0, 600_000.0)] == [0, 1]


def test_maintenance_stream_runs(spark, tmp_path):
    schema = "cache_key string, url string, cache_time double, size_bytes long, readable boolean, version long"
    out = str(tmp_path / "out")

    def load():
        return (spark.createDataFrame([(1, "failed", 1, 0.0, 0.0), (2, "initializing", 0, None, None)], STATUS),
                spark.createDataFrame([("k", "u", 0.0, 1, True, 1)], schema))

    def save(statuses, entries, batch_id):
        statuses.write.mode("overwrite").parquet(f"{out}/status/batch={batch_id}")
        entries.write.mode("overwrite").parquet(f"{out}/cache/batch={batch_id}")

    query = maintenance.stream_maintenance(spark, load, save, lambda: 600_000.0, str(tmp_path / "c"), "1 second")
    try:
        for _ in range(60):
            if query.lastProgress:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert [r.request_id for r in spark.read.parquet(f"{out}/status/batch=0").collect()] == [2]
    assert spark.read.parquet(f"{out}/cache/batch=0").count() == 0
