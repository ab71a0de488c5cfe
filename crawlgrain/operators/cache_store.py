"""The analysis cache as a table of deltas, bucketed by key and partitioned by time.

An upsert appends its entries, and nothing else is read or written: each row carries the number of its commit, and a commit
counts once a manifest names it. A reader takes one manifest, so it sees whole commits only, whatever is being written. Which
entry of a key is the newest is found on narrow columns; the payload is neither sorted nor shuffled. Since the table is
bucketed by key, joins with pages bucketed alike move no page either.

Entries of a span of time lie in a folder of their own. Expiry removes the folders whose latest possible time has run out and
reads none that holds a live entry. After ``COMPACT_AFTER`` commits the live entries are written anew, bucket by bucket.

A manifest is put in place by renaming a file that must not be there yet, which is atomic on HDFS and local disks. If another
writer was faster, an upsert is tried again on its manifest, and a compaction is given up.
"""

from __future__ import annotations

import hashlib
import json
import random
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crawlgrain import fixed_values as V
from crawlgrain.operators.cache import age, cache_key, expired
from crawlgrain.session import drop_folder

CACHE_COLUMNS = "cache_key string, url string, cache_time double, size_bytes long, readable boolean, version long, analysis string"
BUCKETS = 64
#: Seconds of entries in one folder: an eighth of a lifetime, so at most that much dead weight stays.
PART_SECONDS = V.CACHE_SECONDS // 8
COMPACT_AFTER = 50
_TRIES = 20
_OWN = ("commit", "entry", "part")


class Conflict(RuntimeError):
    """Another writer has put its manifest in place first."""


class CacheStore:
    """A cache under ``root``, in any store that Spark writes to. ``columns`` must hold those of ``CACHE_COLUMNS`` but the last."""

    def __init__(self, spark: SparkSession, root: str, columns: str = CACHE_COLUMNS, buckets: int = BUCKETS,
                 part_seconds: int = PART_SECONDS):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns
        self.buckets, self.part_seconds = buckets, part_seconds

    # -- manifest --------------------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest: version, generation of the table, and the commits that count in it."""
        fs, folder = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        versions = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]
        if not versions:
            return {"version": 0, "generation": 0, "commits": []}
        lines = self.spark.read.text(f"{self.root}/manifest/{max(versions)}.json").collect()
        return json.loads("".join(r.value for r in lines))

    def _put(self, state: dict) -> None:
        fs, draft = self._fs(), self._path("manifest", f"draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        final = self._path("manifest", f"{state['version']}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {state['version']} is there already")
        old = self._path("manifest", f"{state['version'] - _TRIES}.json")
        fs.delete(old, False)

    # -- the table -------------------------------------------------------------------------------
    def _table(self, generation: int) -> str:
        name = f"cache_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_{generation}"
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} ({self.columns}, commit long, entry long, part long) USING parquet
            PARTITIONED BY (part) CLUSTERED BY (cache_key) INTO {self.buckets} BUCKETS LOCATION '{self.root}/data-{generation}'""")
        self.spark.sql(f"REFRESH TABLE {name}")  # others may have written or removed files
        return name

    def _part(self) -> Column:
        return F.floor(F.coalesce("cache_time", F.lit(0.0)) / self.part_seconds)

    def _append(self, entries: DataFrame, generation: int, version: int) -> int:
        commit = version << 20 | random.getrandbits(20)
        columns = [c.split()[0] for c in self.columns.split(",")]
        # One task a bucket, so a commit adds one file to each bucket and folder it touches.
        rows = entries.select(*columns).repartition(self.buckets, "cache_key").withColumns(
            {"commit": F.lit(commit).cast("long"), "entry": F.monotonically_increasing_id(), "part": self._part()})
        rows.write.insertInto(self._table(generation))
        return commit

    def upsert(self, entries: DataFrame) -> None:
        """Add entries; the later one of each key, by time, then version, then commit, is the one that is read."""
        for _ in range(_TRIES):
            state = self.manifest()
            commit = self._append(entries, state["generation"], state["version"] + 1)
            for _ in range(_TRIES):
                try:
                    self._put(state | {"version": state["version"] + 1, "commits": [*state["commits"], commit]})
                    return
                except Conflict:
                    again = self.manifest()
                if again["generation"] != state["generation"]:
                    break  # a compaction came in between: the entries must go to the new table
                state = again
        raise Conflict("other writers were faster each time")

    # -- reading ---------------------------------------------------------------------------------
    def _rows(self, state: dict, where: Column | None = None) -> DataFrame:
        rows = self.spark.table(self._table(state["generation"])).where(F.col("commit").isin(state["commits"]))
        return rows if where is None else rows.where(where)

    def _newest(self, rows: DataFrame) -> DataFrame:
        order = lambda: F.struct(F.coalesce("cache_time", F.lit(0.0)).alias("time"), "version", "commit", "entry")
        best = rows.groupBy("cache_key").agg(F.max(order()).alias("best"))
        # Both sides lie in the same buckets. The condition is no equality, so that the key alone decides on partitions.
        met = rows.withColumn("own", order()).join(best.hint("shuffle_hash"), "cache_key").where("own >= best")
        return met.drop("own", "best", *_OWN)

    def read(self) -> DataFrame:
        """The newest entry of each key."""
        return self._newest(self._rows(self.manifest()))

    def fresh(self, now: float, ttl: int = V.CACHE_SECONDS) -> DataFrame:
        """Newest entry per key if it is younger than the lifetime and readable; older folders are not read."""
        alive = (F.col("part") >= self._first_live(now, ttl)) & (age(now) < ttl)
        return self._newest(self._rows(self.manifest(), alive)).where("readable")

    def entries(self, url: str) -> DataFrame:
        """The newest entry of one url: one bucket is read."""
        key = hashlib.md5(url.encode()).hexdigest()
        return self._newest(self._rows(self.manifest(), F.col("cache_key") == key))

    # -- clean-up --------------------------------------------------------------------------------
    def _first_live(self, now: float, ttl: int) -> int:
        """The first folder that may hold an entry younger than ``ttl``."""
        return int((now - ttl) // self.part_seconds)

    def parts(self) -> list[int]:
        """The folders of the table, one for each span of time it holds."""
        fs, folder = self._fs(), self._path(f"data-{self.manifest()['generation']}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("part=")) for n in names if n.startswith("part="))

    def expire(self, now: float, ttl: int = V.CACHE_SECONDS) -> int:
        """Remove the folders in which every entry has run out; returns how many entries they held."""
        state = self.manifest()
        first = self._first_live(now, ttl)
        dead = [p for p in self.parts() if p < first]
        removed = self._rows(state, F.col("part") < first).count() if dead else 0
        for part in dead:
            drop_folder(self.spark, f"{self.root}/data-{state['generation']}/part={part}")
        return removed

    def compact(self, now: float, ttl: int = V.CACHE_SECONDS) -> bool:
        """Write the live entries to a new table; readers of the old one go on until the next compaction. False if another
        writer came in between."""
        state = self.manifest()
        generation, version = state["generation"] + 1, state["version"] + 1
        drop_folder(self.spark, f"{self.root}/data-{generation}")  # left by a compaction that was given up
        live = self._newest(self._rows(state)).where(~expired(now, ttl))
        commit = self._append(live, generation, version)
        try:
            self._put({"version": version, "generation": generation, "commits": [commit]})
        except Conflict:
            drop_folder(self.spark, f"{self.root}/data-{generation}")
            return False
        if generation > 1:
            drop_folder(self.spark, f"{self.root}/data-{generation - 2}")
        return True

    def tidy(self, now: float, ttl: int = V.CACHE_SECONDS) -> None:
        """What maintenance does: expiry, and a compaction once there are many commits."""
        self.expire(now, ttl)
        if len(self.manifest()["commits"]) >= COMPACT_AFTER:
            self.compact(now, ttl)


def bucket_pages(pages: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write pages as table ``name``, bucketed by cache key as a store of as many buckets is."""
    keyed = pages.withColumn("cache_key", cache_key(F.col("url")))
    keyed.repartition(buckets, "cache_key").write.bucketBy(buckets, "cache_key").option("path", path).saveAsTable(name)
    return pages.sparkSession.table(name)
