"""Periodic clean-up: statuses every minute, the analysis cache every ten minutes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from crawlgrain.operators.cache import expire_cache
from crawlgrain.operators.cache_store import CacheStore
from crawlgrain.operators.status import expire_status

STATUS_PERIOD_SECONDS = 60
CACHE_PERIOD_SECONDS = 600


def cache_due(now: float, last: float | None) -> bool:
    """Whether the cache's turn has come, given when it was last cleaned: a late tick still counts."""
    return last is None or now - last >= CACHE_PERIOD_SECONDS


def maintain(statuses: DataFrame, cache: DataFrame, now: float, last: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(statuses, cache entries) that stay after a clean-up at ``now``; ``last``: when the cache was last cleaned."""
    return expire_status(statuses, now), expire_cache(cache, now)[0] if cache_due(now, last) else cache


def stream_maintenance(
    spark: SparkSession, load: Callable[[], tuple[DataFrame, DataFrame]],
    save: Callable[[DataFrame, DataFrame, int], None], clock: Callable[[], float], checkpoint: str,
    period: str = f"{STATUS_PERIOD_SECONDS} seconds",
) -> StreamingQuery:
    """Run ``maintain`` on a tick stream; ``save`` writes the kept tables to a new version for the batch id. The cache is
    cleaned at the first tick after a start and then whenever its period has passed."""
    last: float | None = None

    def tick(_: DataFrame, batch_id: int) -> None:
        nonlocal last
        now = clock()
        save(*maintain(*load(), now, last), batch_id)
        last = now if cache_due(now, last) else last

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(
        processingTime=period).start()


def stream_tidy(spark: SparkSession, store: CacheStore, clock: Callable[[], float], checkpoint: str,
                period: str = f"{CACHE_PERIOD_SECONDS} seconds") -> StreamingQuery:
    """Tidy a cache store in every period: drop the folders that have run out, compact it after many commits."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, batch_id: store.tidy(clock())).option(
        "checkpointLocation", checkpoint).trigger(processingTime=period).start()
