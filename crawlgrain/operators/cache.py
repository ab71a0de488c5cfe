"""Analysis cache: a Parquet table of dated entries per url key, with a lifetime. Entries may carry the stored analysis
as JSON in a column ``analysis``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crawlgrain import fixed_values as V


def cache_key(url: Column) -> Column:
    return F.md5(url)


def age(now: float) -> Column:
    """Seconds since the entry was written; an entry without a time is as old as the epoch."""
    return F.lit(now) - F.coalesce("cache_time", F.lit(0.0))


def latest_per_key(cache: DataFrame) -> DataFrame:
    """Newest entry of each key, the higher version on equal times. The rank is cut below the shuffle as well, so a key
    with very many versions sends one row per task."""
    newest = Window.partitionBy("cache_key").orderBy(F.desc(F.coalesce("cache_time", F.lit(0.0))), F.desc("version"))
    return cache.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").select(*cache.columns)


def fresh_cache(cache: DataFrame, now: float, ttl: int = V.CACHE_SECONDS) -> DataFrame:
    """Newest entry per key, when it is younger than the lifetime and readable. Stale entries are filtered in the
    scan: if the newest entry is stale, so are all others."""
    return latest_per_key(cache.filter(age(now) < ttl)).filter("readable")


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both, the later entry of each key winning."""
    return latest_per_key(cache.unionByName(new))


def write_cache(cache: DataFrame, path: str, buckets: int = 256, files_per_bucket: int = 4) -> None:
    """Write to a new path, partitioned by key hash so that a lookup by key reads one folder. Rows are gathered per
    file first, so the number of files does not grow with the number of tasks."""
    hashed = F.xxhash64("cache_key")
    bucket = F.pmod(hashed, F.lit(buckets)).cast("int")
    part = F.pmod(F.shiftright(hashed, 32), F.lit(files_per_bucket))
    cache.withColumn("bucket", bucket).repartition("bucket", part).write.partitionBy("bucket").parquet(path)


def read_cache(spark: SparkSession, path: str, keys: DataFrame | None = None, buckets: int = 256) -> DataFrame:
    """The cache written by ``write_cache``; with a table of ``cache_key``, only the folders its keys fall into, at most
    ``buckets`` numbers on the driver."""
    cache = spark.read.parquet(path)
    if keys is not None:
        bucket = F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).cast("int")
        cache = cache.where(F.col("bucket").isin([r[0] for r in keys.select(bucket).distinct().collect()]))
    return cache.drop("bucket")


def clear_cache(cache: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """The cache without the given urls, or empty when none are given."""
    if urls is None:
        return cache.limit(0)
    return cache.join(urls.select(cache_key(F.col("url")).alias("cache_key")), "cache_key", "left_anti").select(
        *cache.columns)


def expired(now: float, ttl: int = V.CACHE_SECONDS) -> Column:
    return ~F.coalesce("readable", F.lit(False)) | (age(now) >= ttl)


def expire_cache(cache: DataFrame, now: float, ttl: int = V.CACHE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(kept entries, one row with the number removed)."""
    return (cache.filter(~expired(now, ttl)),
            cache.agg(F.count_if(expired(now, ttl)).alias("removed")))


def cache_stats(cache: DataFrame, now: float, ttl: int = V.CACHE_SECONDS) -> DataFrame:
    """Entries, expired entries, bytes, and mean age in hours (readable ages over all entries)."""
    ages = F.sum(F.when(F.col("readable"), age(now)))
    return cache.agg(
        F.count("*").alias("total_entries"), F.count_if(expired(now, ttl)).alias("expired_entries"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.coalesce(F.round(ages / F.nullif(F.count("*"), F.lit(0)) / 3600, 6), F.lit(0.0)).alias("average_age_hours"))
