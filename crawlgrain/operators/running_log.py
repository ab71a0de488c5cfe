"""Running totals that go on: a log whose sums are kept by block, so that new rows extend the totals without summing it again.

Rows fall into blocks of 2**bits consecutive order values. Kept are the rows with the running sums within their block, in a folder
per block, and a narrow table of the sums of each block and key. An append reads and rewrites the blocks that its rows fall into,
usually the last one, and nothing else; a row's total is its sum within the block plus the sums of the blocks before, which are
added up from the narrow table when they are asked for.

An append counts once its sums are written; until then readers see the one before. One writer at a time. Appending rows again,
after a failure for instance, changes nothing: of rows with the same keys and order value one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from crawlgrain.functions.expr import or_zero
from crawlgrain.session import drop_folder

_MADE = ("_append", "_block", "_super")


class RunningLog:
    """Running sums of ``values`` in ``order`` per ``keys`` under ``root``. ``order`` is a non-negative whole number, unique within
    its keys; keys are not null."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: str, values: list[str], bits: int = 16):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), keys, order
        self.values, self.bits = values, bits

    def _appends(self) -> list[int]:
        """Finished appends: those whose table of sums is complete."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/sums")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath() for s in fs.listStatus(where)]
        done = [p.getName() for p in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix("append=")) for n in done)

    def _sums(self, appends: list[int]) -> DataFrame:
        """Sums per key of each block, as its last append left them; a block without rows of a key has none."""
        read = self.spark.read.option("basePath", f"{self.root}/sums").parquet(*[f"{self.root}/sums/append={a}" for a in appends])
        last = read.groupBy("_block").agg(F.max("append").alias("_append"))
        return read.withColumnRenamed("append", "_append").join(last, ["_block", "_append"])

    def _rows(self, folders: list[str]) -> DataFrame:
        every = self.spark.read.option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/{f}" for f in folders])
        return every.withColumnRenamed("append", "_append").withColumnRenamed("block", "_block")

    def append(self, new: DataFrame) -> None:
        """Add rows; those of touched blocks, old and new, are written anew, with their sums."""
        appends = self._appends()
        number = appends[-1] + 1 if appends else 0
        fresh = new.withColumn("_block", F.shiftright(self.order, self.bits))
        touched = [r[0] for r in fresh.select("_block").distinct().collect()]  # of k rows, at most k, and few as the log goes on
        if not touched:
            return
        rows, replaced = fresh, []
        if appends:
            of = self._sums(appends).where(F.col("_block").isin(touched)).select("_append", "_block").distinct()
            replaced = [tuple(r) for r in of.collect()]
        if replaced:
            # Open blocks are named folder by folder, so others are neither listed nor read.
            kept = self._rows([f"append={a}/block={b}" for a, b in replaced]).select(*new.columns, "_block")
            rows = kept.unionByName(fresh).dropDuplicates([*self.keys, self.order])
        window = Window.partitionBy("_block", *self.keys).orderBy(self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = rows.withColumns({f"_l_{v}": F.sum(v).over(window) for v in self.values})
        folder = f"{self.root}/rows/append={number}"
        local.withColumn("block", F.col("_block")).drop("_block").write.mode("overwrite").partitionBy("block").parquet(folder)
        written = self._rows([f"append={number}"])
        sums = written.groupBy("_block", *self.keys).agg(*[F.sum(v).alias(v) for v in self.values])
        sums.write.mode("overwrite").parquet(f"{self.root}/sums/append={number}")
        # What this append replaced was still read until now; what the one before replaced no longer is.
        self._drop_replaced(appends)

    def _drop_replaced(self, appends: list[int]) -> None:
        if len(appends) < 2:
            return
        last = self._sums(appends).select("_append", "_block").distinct()
        newest = self.spark.read.parquet(f"{self.root}/sums/append={appends[-1]}").select("_block").distinct()
        earlier = self.spark.read.option("basePath", f"{self.root}/sums").parquet(
            *[f"{self.root}/sums/append={a}" for a in appends[:-1]]).select(F.col("append").alias("_append"), "_block").distinct()
        gone = earlier.join(newest, "_block", "left_semi").join(last, ["_append", "_block"], "left_anti").collect()
        for r in gone:
            drop_folder(self.spark, f"{self.root}/rows/append={r._append}/block={r._block}")

    def totals(self) -> DataFrame:
        """Every row with ``running_<value>`` after it."""
        appends = self._appends()
        if not appends:
            raise ValueError("nothing has been appended yet")
        sums = self._sums(appends).withColumn("_super", F.shiftright("_block", self.bits))
        before = (Window.unboundedPreceding, -1)
        supers = sums.groupBy(*self.keys, "_super").agg(*[F.sum(v).alias(v) for v in self.values])
        in_key = Window.partitionBy(*self.keys).orderBy("_super").rowsBetween(*before)
        in_super = Window.partitionBy(*self.keys, "_super").orderBy("_block").rowsBetween(*before)
        above = supers.select(*self.keys, "_super", *[F.sum(v).over(in_key).alias(f"_s_{v}") for v in self.values])
        offsets = sums.select(*self.keys, "_append", "_super", "_block", *[F.sum(v).over(in_super).alias(f"_b_{v}") for v in self.values])
        offsets = offsets.join(above, [*self.keys, "_super"]).select(
            "_append", "_block", *self.keys, *[(or_zero(F.col(f"_b_{v}")) + or_zero(F.col(f"_s_{v}"))).alias(f"_o_{v}") for v in self.values])
        rows = self._rows([f"append={a}" for a in appends])
        own = [c for c in rows.columns if c not in _MADE and not c.startswith("_l_")]
        # The narrow side names the append that holds a block, which leaves out blocks that were replaced.
        return rows.join(offsets, ["_append", "_block", *self.keys]).select(
            *own, *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"running_{v}") for v in self.values])
