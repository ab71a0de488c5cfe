"""What the operators of this folder share: table readers, bounded batches, word hashes and the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from crawlgrain.session import shared_folder

# Bytes of one Arrow batch sent to Python, and of the texts worked on at once.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker gets at once by bytes, so that long texts cannot fill its memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and the next operator needs the room."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes."""
    prepare(df.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def kept_columns(df: DataFrame, made: tuple[str, ...]) -> list[str]:
    """Columns of ``df`` that stay beside the ``made`` ones; names are compared as Spark does, without case."""
    lower = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in lower]


# -- the shared folder ---------------------------------------------------------------------------
def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator call below ``spark.checkpoint.dir``; dropped when no longer read, the rest at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: the lineage ends there, and lost executors cost nothing."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def _end(self) -> None:
        # At exit the session may be gone already; what is left then belongs to the folder's own clean-up.
        with contextlib.suppress(Exception):
            _delete(self.spark, self.root)


# -- batches -------------------------------------------------------------------------------------
def text_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches with a ``text`` column so that each part holds about ``size`` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
        start = 0
        while start < n:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def words_of(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased: both bytes methods know ASCII only."""
    return raw.lower().split() if raw else []


# -- hashes --------------------------------------------------------------------------------------
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x

