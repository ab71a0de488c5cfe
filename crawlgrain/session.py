"""Session settings and the one way this package cuts lineage: a table written to the shared folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Partition counts and memory stay with the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # That rule copies an exploded expression into a filter below, so the whole feature would be computed twice a page.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    # A page row may hold megabytes, so few rows per Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


EXCLUDED_RULES = "spark.sql.optimizer.excludedRules"


def configure(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on; rules that the caller excludes stay excluded."""
    for key, value in RUNTIME_SETTINGS.items():
        if key == EXCLUDED_RULES:
            own = [r.strip() for r in (spark.conf.get(key, None) or "").split(",") if r.strip()]
            value = ",".join(dict.fromkeys([*own, value]))
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, app_name: str = "crawlgrain", **settings: str) -> SparkSession:
    """A configured session; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or one in the warehouse, which driver and executors share as well.

    A warehouse on a local disk is shared only where the whole session runs on one machine; elsewhere it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        if is_machine_local(folder, spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def is_machine_local(folder: str, master: str) -> bool:
    """Whether executors of this master may not see the folder."""
    scheme = folder.split(":", 1)[0] if "://" in folder or folder.startswith("file:") else "file"
    return scheme == "file" and not master.startswith("local")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of this package's own tables, in whatever store it lies; nothing happens if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for one piece of work; the caller's own come back afterwards."""
    old = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
