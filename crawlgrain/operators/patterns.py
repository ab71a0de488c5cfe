"""Which patterns of a table are contained in which texts, ignoring case.

Each pattern is indexed by one of its trigrams, the one that the fewest texts hold. Texts meet patterns by an equi-join on
trigrams, so a text is compared with the patterns whose rarest trigram it holds instead of with all of them, and each pair that
meets is verified. Trigrams are cut, counted and joined on narrow rows; texts move once, for the verification.

Defined cases: patterns shorter than three characters are indexed whole, and the empty one is contained in every text. Null
texts and null patterns match nothing. Equal patterns match each for itself. Rows that share all keys are searched row by row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

GRAM = 3


def grams_of(text: Column, sizes: list[int]) -> Column:
    """The distinct pieces of ``text`` of the given lengths. Look-ahead lets the matches overlap."""
    found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)) if n else F.array(F.lit("")) for n in sizes]
    return F.array_distinct(F.concat(*found))


def pattern_index(texts: DataFrame, patterns: DataFrame) -> tuple[DataFrame, list[int]]:
    """gram, _pattern of each of ``patterns`` (_pattern, _text), and the lengths of grams. ``texts`` has a column ``_text``."""
    size = F.least(F.length("_text"), F.lit(GRAM))
    sizes = sorted(r[0] for r in patterns.where("_text IS NOT NULL").select(size).distinct().collect())  # of 0 to 3
    if not sizes:
        return patterns.select(F.lit("").alias("gram"), "_pattern"), []
    pieces = F.filter(grams_of(F.col("_text"), sizes), lambda g: F.length(g) == size)
    held = patterns.select("_pattern", F.explode(pieces).alias("gram"))
    counts = texts.select(F.explode(grams_of(F.col("_text"), sizes)).alias("gram")).join(
        held.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    # A gram that no text holds is rarest of all: its pattern meets nothing.
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best")
    return held.join(counts, "gram", "left").groupBy("_pattern").agg(rarest).select(F.col("best.gram").alias("gram"), "_pattern"), sizes


def find_patterns(rows: DataFrame, keys: list[str], text: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``keys`` of ``rows`` with all columns of each of ``patterns`` whose ``pattern`` is contained in ``text``.

    ``patterns`` is read more than once, so it should be a stored table or a small one; its columns differ from ``keys``."""
    texts = rows.select(*keys, F.lower(text).alias("_text")).where("_text IS NOT NULL")
    numbered = patterns.withColumn("_text", F.lower(pattern)).withColumn("_pattern", F.col("_text"))
    distinct = numbered.select("_pattern", "_text").distinct()
    index, sizes = pattern_index(texts, distinct)
    meet = texts.select(*keys, F.explode(grams_of(F.col("_text"), sizes or [0])).alias("gram")).join(index, "gram")
    candidates = meet.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_pattern").distinct()
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    found = texts.join(candidates, same).where(F.col("_text").contains(F.col("_pattern"))).select(*keys, "_pattern")
    return found.join(numbered.drop("_text"), "_pattern").drop("_pattern")


def in_order(found: DataFrame, keys: list[str], order: str, name: str = "ord") -> DataFrame:
    """``found`` with the place of each pattern among those of its row, from 0 in ``order``."""
    place = Window.partitionBy(*keys).orderBy(order)
    return found.withColumn(name, F.row_number().over(place) - 1)


def classify_errors_by(attempts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``job_logs.classify_errors`` with the catalogue as a table (priority, error_type, explanation, recommendation)."""
    keys = ["request_id", "attempt_no"]
    found = find_patterns(attempts, keys, "stderr", patterns, "error_type")
    return in_order(found, keys, "priority").select(*keys, "ord", "error_type", "explanation", "recommendation")


def match_data_types_by(requests: DataFrame, words: DataFrame) -> DataFrame:
    """``job_logs.match_data_types`` with the words as a table (priority, data_type, word): the three types of the first words
    found. Nothing found gives generic; a wish for several items repeats a lone match."""
    found = find_patterns(requests, ["request_id"], "expected_data", words, "word")
    first = found.groupBy("request_id", "data_type").agg(F.min("priority").alias("priority"))
    named = in_order(first, ["request_id"], "priority").where("ord < 3").groupBy("request_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "data_type"))), lambda x: x["data_type"]).alias("names"))
    text = F.lower("expected_data")
    several = text.contains("list") | text.contains("multiple")
    all_rows = requests.select("request_id", several.alias("several")).join(named, "request_id", "left")
    types = F.when(F.col("names").isNull(), F.array(F.lit("generic"))).when(
        F.col("several") & (F.size("names") == 1), F.concat("names", "names")).otherwise(F.col("names"))
    return all_rows.select("request_id", F.posexplode(types).alias("ord", "data_type"))
