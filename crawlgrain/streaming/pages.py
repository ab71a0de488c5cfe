"""Pages analysed as their files land, each url once in a lifetime.

The state of a url is the time it was last let through, in RocksDB. A batch asks it for its own urls only and reads no earlier
results. The time is the clock's when the page arrives; it is the event time as well, so a timer forgets a url in whose lifetime
nothing came. Pages of one url meet in one task; each Arrow batch sends but the first of them there, so a hot url is a few rows.

The clock is asked in the tasks, too, so it must not hold a session.

Defined cases: of several pages of a url in a batch the one with the smallest id is taken, one without an id last; equal rows
count once. Pages without a url have nothing in common and are all let through. A clock that goes back by more than a
lifetime makes pages late, and late pages are not analysed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from crawlgrain import fixed_values as V
from crawlgrain.operators.cache import fresh_cache
from crawlgrain.plans.analysis import analyze_pages, as_stored, cache_entries
from crawlgrain.session import drop_folder, settings
from crawlgrain.sources.tables import PAGES_SCHEMA
from crawlgrain.streaming.stages import STATE_STORE

CACHE_SCHEMA = (
    "cache_key string, url string, cache_time double, size_bytes long, readable boolean, version long, analysis string"
)
# Batches after which folders of cache entries that have all run out are removed.
COMPACT_EVERY = 20
# Tasks that pages without a url are dealt out to.
_SALTS = 64


def page_stream(spark: SparkSession, in_dir: str, file_filter: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(PAGES_SCHEMA).option("pathGlobFilter", file_filter).parquet(in_dir)


def _first_of_batch(clock: Callable[[], float]):
    """Arrow batches with the time of arrival and, of each url, only the page with the smallest id."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = float(clock())
        for batch in batches:
            order = pc.sort_indices(pa.Table.from_batches([batch.select(["page_id"])]), sort_keys=[("page_id", "ascending")], null_placement="at_end")
            urls, seen, kept = batch.column("url").to_pylist(), set(), []
            for row in order.to_pylist():
                if urls[row] is None or urls[row] not in seen:
                    seen.add(urls[row])
                    kept.append(row)
            first = batch.take(pa.array(sorted(kept), pa.int64()))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array([now] * first.num_rows, pa.float64())],
                                             names=[*batch.schema.names, "arrived"])

    return work


class OncePerLifetime(StatefulProcessor):
    """Lets one page of a url through, then none until its lifetime is over."""

    def __init__(self, lifetime: float):
        self.lifetime = lifetime

    def init(self, handle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues):
        if not key[0].startswith("="):
            for row in rows:
                yield self._page(row)
            return
        first = min(rows, key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
        last, now = self._last.get(), first["arrived"]
        if last is None or now - last[0] >= self.lifetime:
            self._let(now)
            yield self._page(first)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._let(initialState["at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self._last.get()
        if last is not None and self._ends(last[0]) <= timerValues.getCurrentWatermarkInMs():
            self._last.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _let(self, at: float) -> None:
        self._last.update((at,))
        self._handle.registerTimer(self._ends(at))

    def _ends(self, at: float) -> int:
        return int((at + self.lifetime) * 1000) + 1

    @staticmethod
    def _page(row) -> Row:
        return Row(page_id=row["page_id"], url=row["url"], html=row["html"])


def once_per_url(pages: DataFrame, clock: Callable[[], float], cache: DataFrame | None = None,
                 lifetime: int = V.CACHE_SECONDS) -> DataFrame:
    """The pages of a stream that are to be analysed. The urls of ``cache``, its fresh entries by the clock at the start,
    count as let through when they were stored."""
    known = F.concat(F.lit("="), "url")
    salt = F.concat(F.lit("~"), F.pmod(F.xxhash64("page_id", "html"), F.lit(_SALTS)).cast("string"))
    arrived = pages.select("page_id", "url", "html").mapInArrow(_first_of_batch(clock), f"{PAGES_SCHEMA}, arrived double")
    # Spark drops what lies at the watermark, too: a microsecond keeps that.
    timed = arrived.withColumns({"key": F.coalesce(known, salt), "ts": F.timestamp_micros((F.col("arrived") * 1_000_000).cast("long") + 1)})
    first = None
    if cache is not None:
        first = fresh_cache(cache, clock(), lifetime).where("url IS NOT NULL").select(known.alias("key"), F.col("cache_time").alias("at")).groupBy("key")
    return timed.withWatermark("ts", f"{lifetime} seconds").groupBy("key").transformWithState(
        OncePerLifetime(lifetime), PAGES_SCHEMA, "Append", "EventTime", first)


def stream_analyze(pages: DataFrame, out_dir: str, checkpoint: str, clock: Callable[[], float],
                   cache: DataFrame | None = None, context: Callable[[], dict] = dict, **trigger) -> StreamingQuery:
    """Write ``out_dir/analysis/batch=n`` (page_id, url, analysis as JSON) and ``out_dir/cache/at=time/batch=n``.

    A url with an entry, given or made by an earlier batch, that is fresh by the ``clock`` is skipped. ``context()`` gives each
    batch the optional tables of ``analyze_pages``. A batch retried after a failure overwrites its own folders, so results are
    written once. Cache folders of times that have run out are removed whole.
    """
    spark = pages.sparkSession

    def analyze(batch: DataFrame, batch_id: int) -> None:
        now, chosen, folder = clock(), f"{out_dir}/chosen/batch={batch_id}", f"{out_dir}/analysis/batch={batch_id}"
        # The batch is used once, as a second use would ask the state again; the analysis may read its pages twice.
        batch.write.mode("overwrite").parquet(chosen)
        as_stored(analyze_pages(spark.read.schema(PAGES_SCHEMA).parquet(chosen), **context())).write.mode("overwrite").parquet(folder)
        new = cache_entries(spark.read.parquet(folder), now)
        new.write.mode("overwrite").parquet(f"{out_dir}/cache/at={int(now)}/batch={batch_id}")
        drop_folder(spark, chosen)
        if batch_id and batch_id % COMPACT_EVERY == 0:
            drop_dead(spark, f"{out_dir}/cache", now)

    kept = once_per_url(pages, clock, cache)
    # State is tidied in the batches that bring pages; none is run for that alone.
    with settings(spark, STATE_STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        return kept.writeStream.outputMode("append").foreachBatch(analyze).option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})).start()


def drop_dead(spark: SparkSession, folder: str, now: float, lifetime: int = V.CACHE_SECONDS) -> None:
    """Remove the folders ``at=time`` whose entries have all run out, by their names alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    for name in names:
        if name.startswith("at=") and int(name.removeprefix("at=")) + 1 <= now - lifetime:
            drop_folder(spark, f"{folder}/{name}")
