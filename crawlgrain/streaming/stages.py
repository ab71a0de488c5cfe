"""Live stage status as keyed state.

Events are folded to mergeable facts (``operators.status``) per request, stage and minute in the map tasks, so a request with
very many events sends a few rows a task. Requests are dealt by hash to ``shards``, whose facts lie together in RocksDB, which
logs what a batch changes: a batch reads and writes the shards of the requests it names and no others. A call to the state costs far
more than a row in it, so a shard's requests share their calls. The status of all requests is read from the
state of the last finished batch (``read_status``); the requests that a batch touched are written beside it.

With ``late``, event time rules: events behind the watermark no longer count and are counted as late, and a timer per shard
removes a request when its status runs out by the watermark, also when it stays silent. Without it nothing is late and every request
stays; ``now``, the reader's clock, then hides those that have run out.

Defined cases: events without a stage or request are a stage or request of their own. An event without a time is
never late. A request that comes again after its removal begins anew.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from crawlgrain import fixed_values as V
from crawlgrain.operators.status import expire_status, request_status
from crawlgrain.session import drop_folder, settings
from crawlgrain.streaming import stage_fold as fold

# The fold travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(fold)

EVENT_SCHEMA = (
    "event_id long, request_id long, stage string, action string, ts_s double, details string"
)
# A stage outside the fixed order.
EXTRA_STAGE = "website_analysis"
# Batches whose touched requests stay readable.
KEPT_CHANGES = 100
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# Keys of the state, fixed for a checkpoint: some dozens of the requests held to a shard are cheapest.
SHARDS = 1 << 15
LIFETIMES = (tuple(V.FINAL_STAGES), float(V.STATUS_SECONDS), float(V.FINISHED_STATUS_SECONDS))
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_FLAT = pa.schema([("request_id", pa.int64()), ("stage_key", pa.string()), *((n, _ARROW[t]) for n, t in fold.FIELDS)])
_FOLDED = pa.schema([*list(_FLAT)[:2], ("newest", pa.float64()), ("events", pa.int64()), *list(_FLAT)[2:]])
_KEPT_ROW = Row("request_id", "stage_key", "events", "removed", *(n for n, _ in fold.FIELDS))


class StageStream:
    """A running stream of stage events; everything else is as in the query it holds."""

    def __init__(self, query: StreamingQuery, checkpoint: str, now: Callable[[int], float] | None):
        self.query, self.checkpoint, self.now = query, checkpoint, now

    def __getattr__(self, name: str):
        return getattr(self.query, name)

    def counts(self) -> dict[str, int]:
        """Events seen and taken into the state, those too late for it, and requests removed, over the recent batches."""
        total = dict.fromkeys(("seen", "taken", "removed"), 0)
        for progress in self.query.recentProgress:
            metrics = progress.observedMetrics
            for name, source in (("seen", "stage_input"), ("taken", "stage_output"), ("removed", "stage_output")):
                total[name] += (metrics[source][name] or 0) if source in metrics else 0
        return total | {"late": total["seen"] - total["taken"]}


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = fold.fold_events(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_pylist(rows, schema=_FOLDED)


@functools.lru_cache(maxsize=4)
def _folded_fields(names: tuple[str, ...]) -> Callable:
    """Reads the folded fields of a row by their places."""
    return operator.itemgetter(*map(names.index, ("request_id", "stage_key", "newest", "events", *(n for n, _ in fold.FIELDS))))


def _unpack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("request_id", "stage_key", *(n for n, _ in fold.FIELDS))
    for batch in batches:
        for text in batch.column("requests").to_pylist():
            rows = [(request, stage, *facts) for request, _, stages in json.loads(text) for stage, facts in stages]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=_FLAT)


class StageKeeper(StatefulProcessor):
    """Merges folded facts into the requests of a shard; with lifetimes, removes a request when its status runs out."""

    def __init__(self, expires: bool):
        self.expires = expires

    def init(self, handle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "requests string")

    def handleInputRows(self, key, rows, timerValues):
        # Each call to the state is a round trip, so a shard is read once and written once for all its requests.
        every, events = self._read(), {}
        watermark = timerValues.getCurrentWatermarkInMs() if self.expires else 0
        old, gone = self._next(every), self._drop(every, watermark)
        changed = set()
        for row in rows:
            request, stage, newest, n, *facts = _folded_fields(tuple(row.__fields__))(row)
            events.setdefault(request, 0)
            # Spark itself drops what lay behind the watermark of the batch before.
            if newest is not None and newest * 1000 < watermark:
                continue
            stages = every.setdefault(request, [None, {}])[1]
            stages[stage] = fold.merge(stages.get(stage), tuple(facts))
            events[request] += n
            changed.add(request)
        for request in changed:
            held = every[request]
            held[0] = fold.due(held[1], *LIFETIMES) if self.expires else None
        if changed or gone:
            self._write(every, old)
        for request in gone:
            yield self._removed(request)
        for request, n in events.items():
            yield from self._rows(request, every[request][1] if request in every else {}, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        every = self._read()
        gone = self._drop(every, timerValues.getCurrentWatermarkInMs())
        if gone:
            # Spark itself deletes the timer that has run out.
            self._write(every, None)
        for request in gone:
            yield self._removed(request)

    def close(self) -> None:
        pass

    def _read(self) -> dict[int | None, list]:
        """Of each request of the shard, when it runs out and the facts of its stages."""
        held = self._held.get()
        return {request: [due, {stage: tuple(facts) for stage, facts in stages}] for request, due, stages in json.loads(held[0])} if held else {}

    def _write(self, every: dict[int | None, list], old: int | None) -> None:
        """One timer per shard, for its request that runs out first; ``old`` is the one it has."""
        if every:
            self._held.update((json.dumps([(request, due, [*stages.items()]) for request, (due, stages) in every.items()]),))
        else:
            self._held.clear()
        at = self._next(every)
        if at == old:
            return
        if old is not None:
            self._handle.deleteTimer(old)
        if at is not None:
            self._handle.registerTimer(at)

    @staticmethod
    def _next(every: dict[int | None, list]) -> int | None:
        """The millisecond after the first status runs out."""
        due = min((due for due, _ in every.values() if due is not None), default=None)
        return None if due is None else math.ceil(due * 1000) + 1

    @staticmethod
    def _drop(every: dict[int | None, list], watermark: int) -> list[int | None]:
        """Requests whose status has run out by the watermark; they leave ``every``."""
        gone = [request for request, (due, _) in every.items() if due is not None and due * 1000 < watermark]
        for request in gone:
            del every[request]
        return gone

    @staticmethod
    def _removed(request: int | None) -> Row:
        return Row(request_id=request, stage_key=None, events=0, removed=1, **dict.fromkeys(n for n, _ in fold.FIELDS))

    @staticmethod
    def _rows(request: int | None, stages: dict[str, tuple], events: int):
        for n, (stage, facts) in enumerate(stages.items()):
            yield _KEPT_ROW(request, stage, 0 if n else events, 0, *facts)


def as_facts(flat: DataFrame) -> DataFrame:
    """Flat facts, as the state holds them, in the form of ``operators.status.stage_facts``."""
    def entry(prefix: str, **fields: str):
        parts = [F.col(f"{prefix}_id").alias("event_id"), *(F.col(c).alias(n) for n, c in fields.items())]
        return F.when(F.col(f"{prefix}_id").isNotNull(), F.struct(*parts))

    stage = F.when(F.col("stage_key").startswith("="), F.substring("stage_key", 2, 1 << 30))
    return flat.select(
        "request_id", stage.alias("stage"), entry("start", ts_s="start_ts", details="start_details").alias("first_start"),
        "last_start", "n_starts", entry("end", ts_s="end_ts", status="end_status").alias("last_end"),
        entry("note", details="note_details").alias("last_note"), entry("fail", details="fail_details").alias("last_fail"),
        "last_complete")


def stream_stages(events: DataFrame, state_dir: str, checkpoint: str, now: Callable[[int], float] | None = None,
                  late: str | None = None, shards: int = SHARDS, **trigger) -> StageStream:
    """Keep the status of each request under ``checkpoint``. ``state_dir/changes/batch=n`` holds the facts of the requests
    that batch ``n`` touched (``read_changes``) and is overwritten when the batch is retried; the last ``KEPT_CHANGES`` stay.

    ``late``: how far events may lie behind the newest one, for instance ``5 minutes``. ``now(batch)``: the reader's clock.
    ``shards``: keys of the state, the same at each start on a checkpoint."""
    spark = events.sparkSession
    folded = events.select("event_id", "request_id", "stage", "action", "ts_s", "details").mapInArrow(_fold_batches, fold.FOLDED)
    # Spark drops what lies at the watermark, too: a microsecond keeps that, and an event at time 0.
    timed = folded.withColumn("ts", F.timestamp_micros((F.col("newest") * 1_000_000).cast("long") + 1)).observe(
        "stage_input", F.sum("events").alias("seen"))
    if late:
        timed = timed.withWatermark("ts", late)
    shard = F.pmod(F.xxhash64("request_id"), F.lit(shards)).cast("int")
    kept = timed.withColumn("shard", shard).groupBy("shard").transformWithState(
        StageKeeper(bool(late)), f"request_id long, stage_key string, events long, removed int, {fold.FACTS}", "Update",
        "EventTime" if late else "None")
    kept = kept.observe("stage_output", F.sum("events").alias("taken"), F.sum("removed").alias("removed"))

    def write(batch: DataFrame, batch_id: int) -> None:
        # Used once: a second use of the batch would run the keeper, and its state, a second time.
        batch.write.mode("overwrite").parquet(f"{state_dir}/changes/batch={batch_id}")
        drop_folder(spark, f"{state_dir}/changes/batch={batch_id - KEPT_CHANGES}")

    with settings(spark, STATE_STORE):
        query = kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})).start()
    return StageStream(query, checkpoint, now)


def read_status(spark: SparkSession, checkpoint: str, now: float | None = None) -> DataFrame:
    """The status of every request in the state of the last finished batch; with ``now``, of those that have not run out."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    flat = state.select("value.requests").mapInArrow(_unpack_shards, f"request_id long, stage_key string, {fold.FACTS}")
    found = request_status(as_facts(flat))
    return found if now is None else expire_status(found, now)


def read_changes(spark: SparkSession, state_dir: str, batch_id: int) -> DataFrame:
    """The statuses of the requests that a batch touched, and a row with ``removed`` for each that it removed."""
    rows = spark.read.parquet(f"{state_dir}/changes/batch={batch_id}")
    left = request_status(as_facts(rows.where("removed = 0"))).withColumn("removed", F.lit(False))
    return left.unionByName(rows.where("removed = 1").select("request_id", F.lit(True).alias("removed")), allowMissingColumns=True)


def stored_status(spark: SparkSession, query: StageStream, state_dir: str) -> DataFrame:
    """Request statuses as of the last finished batch of ``query``, by its clock if it has one."""
    progress = query.lastProgress
    if progress is None:
        raise ValueError("the stream has not finished a batch yet")
    return read_status(spark, query.checkpoint, query.now(progress["batchId"]) if query.now else None)


def stage_event_stream(spark: SparkSession, in_dir: str, schema: str, file_filter: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file_filter).parquet(in_dir)


def as_stage_events(events: DataFrame) -> DataFrame:
    """Stage events read from a raw event stream: event number gives the stage, event type the action."""
    stages = [*V.STAGES, EXTRA_STAGE]
    kind = F.col("event_type")
    return events.select(
        "event_id", F.col("user_id").alias("request_id"),
        F.get(F.array(*map(F.lit, stages)), (F.col("event_id") % 8).cast("int")).alias("stage"),
        F.when(kind.isin("signup", "view"), "start").when(kind.isin("click", "purchase"), "complete")
        .otherwise("fail").alias("action"),
        (F.col("event_id") * 60).cast("double").alias("ts_s"), F.col("props").alias("details"))
