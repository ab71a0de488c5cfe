import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents with the given (id, text) pairs and the other columns of the table; ``lang`` may be a third value."""

    def build(*rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)

    return build


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path, docs_of):
    """Writes documents (and a benchmark) where a query reads them."""

    def build(*rows, benchmark=()):
        docs_of(*rows).write.parquet(str(tmp_path / "documents.parquet"))
        schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
        spark.createDataFrame(list(benchmark), schema).write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return build
