"""Reading the given tables and the tables derived from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain.sources.fixtures import FIXTURES

BASE_TABLES = ["pages", "documents", "conversations", "events", "labels", "benchmark"]
SPREAD = "spark.crawlgrain.spread"
PAGES_SCHEMA = "page_id long, url string, html string"


def table_path(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet"


def base_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(folder, name))


def load_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Crawled pages: page_id, url, html."""
    return base_table(spark, folder, "pages").select("page_id", "url", "html")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan over ``spark.crawlgrain.spread`` partitions, if that setting is given; else leave it unshuffled.

    Raw HTML is the widest data here, so it is moved only where the caller says that the input is a handful of files.
    """
    parts = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(parts, key) if parts else df


def derived_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table by name; the tables its SQL reads are registered as views first."""
    sql = FIXTURES[name]
    for table in set(re.findall(r"\bFROM (\w+)", sql)):
        source = derived_table(spark, folder, table) if table in FIXTURES else base_table(spark, folder, table)
        source.createOrReplaceTempView(table)
    return spark.sql(sql)


def reject_reason() -> "F.Column":
    """Why a request is refused, or null: an http(s) url with a host and the texts are required."""
    host = F.try_parse_url("url", F.lit("HOST"))
    scheme = F.lower(F.try_parse_url("url", F.lit("PROTOCOL")))
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("url", "expected_data", "llm_model")]
    return F.coalesce(
        missing[0],
        F.when(scheme.isNull() | ~scheme.isin("http", "https"), F.lit("url is not http or https")),
        F.when(host.isNull() | (host == ""), F.lit("url has no host")),
        *missing[1:],
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) requests; rejected rows say why."""
    marked = requests.withColumn("reject_reason", reject_reason())
    return (
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()),
    )


def filter_access_log(lines: DataFrame) -> DataFrame:
    """Access-log lines without the status-polling requests."""
    return lines.filter(~((F.col("n_args") >= 3) & F.coalesce(F.col("path").contains("/api/status/"), F.lit(False))))


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text column ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_results(df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Result sink: JSON lines or Parquet, one file per partition."""
    df.write.mode(mode).format(format).save(path)
