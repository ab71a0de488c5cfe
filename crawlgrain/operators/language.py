"""Language of a page: character n-gram profiles trained on labelled documents, applied as a naive Bayes sum.

A profile holds every n-gram of its language as a row. For scoring, n-grams are hashed into a table of fixed size, so what
is broadcast does not grow with the corpus or its alphabets. A page is complete in one row, so its language is one more
expression on that row: a Pandas UDF that scores a batch of samples as arrays, with no rows per n-gram and no shuffle of pages."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from crawlgrain.functions.expr import let

FLOOR = math.log(1e-7)
#: Buckets of the weight table: 4 bytes each and language, so 4 MB a language.
BUCKET_BITS = 20
#: Odd numbers for the code points of a gram and, last, for its length.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


# Pieces of a blank-padded word, by length. Look-ahead lets the matches overlap.
PIECES = [
    r"(?=([ \p{L}]))",
    r"(?=( \p{L}|\p{L}{2}|\p{L} ))",
    r"(?=( \p{L}{2}|\p{L}{3}|\p{L}{2} | \p{L} ))",
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def grams_of(text: Column) -> Column:
    """All 1- to 3-character pieces of the words of ``text``, each word padded with a blank on both sides."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", "  ")), F.lit(" "))
    return let(padded, lambda words: F.when(F.length(words) > 2, F.concat(
        *[F.regexp_extract_all(words, F.lit(piece), F.lit(1)) for piece in PIECES])))


def train_profiles(documents: DataFrame) -> DataFrame:
    """lang, gram, weight: all n-grams of each language with scaled log frequencies above a floor.

    Words are counted first, so n-grams are cut from each distinct word once rather than from the whole corpus;
    every grouping combines inside the map tasks before its shuffle.
    """
    words = documents.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    grams = counted.select("lang", F.explode(grams_of(F.col("word"))).alias("gram"), "n").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    weight = F.round((F.log(F.col("n") / F.col("total")) - FLOOR) * 1000).cast("long")
    return grams.join(totals, "lang").select("lang", "gram", F.greatest(weight, F.lit(1)).alias("weight"))


def bucket_of(gram: Column) -> Column:
    """The bucket of an n-gram: a sum of its code points times ``FACTORS``, and of its length, modulo 2^32, of which the high
    bits count."""
    size = F.length(gram)
    terms = [F.ascii(F.substring(gram, k + 1, 1)).cast("long") * factor for k, factor in enumerate(FACTORS[:-1])]
    total = sum(terms[1:], terms[0]) + size.cast("long") * FACTORS[-1]
    return F.shiftright(total.bitwiseAND(F.lit((1 << 32) - 1)), 32 - BUCKET_BITS).cast("int")


def buckets_of(codes: np.ndarray, size: int) -> np.ndarray:
    """The same for all n-grams of ``size`` of a text given as code points."""
    n = max(0, len(codes) - size + 1)
    total = np.full(n, size * FACTORS[-1], dtype=np.uint64)
    for k in range(size):
        total += codes[k : k + n] * np.uint64(FACTORS[k])
    return ((total & np.uint64((1 << 32) - 1)) >> np.uint64(32 - BUCKET_BITS)).astype(np.int64)


def weight_table(profiles: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a table (languages x buckets) of weights; 0 is no n-gram. Its size, and what the driver gets
    for it, depend on the number of languages alone. Of n-grams that share a bucket the heaviest counts."""
    rows = profiles.groupBy("lang", bucket_of(F.col("gram")).alias("bucket")).agg(F.max("weight").alias("weight")).toPandas()
    languages = sorted(rows["lang"].unique())
    table = np.zeros((len(languages), 1 << BUCKET_BITS), dtype=np.int32)
    table[np.searchsorted(languages, rows["lang"]) if len(rows) else [], rows["bucket"]] = rows["weight"]
    return languages, table


def score_samples(samples: list[str], languages: list[str], table: np.ndarray) -> list[str]:
    """Samples of words separated by blanks -> languages. A batch is one array of n-grams whose weights are added up by row."""
    padded = [f" {s.replace(' ', '  ')} " if s else "" for s in samples]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(samples)), [len(p) for p in padded])
    total, known = np.zeros((len(languages), len(samples)), dtype=np.int64), np.zeros(len(samples), dtype=bool)
    blank = codes == 32
    for size in (1, 2, 3):
        n = max(0, len(codes) - size + 1)
        # A gram lies within one padded word: it does not hold the two blanks between words or samples.
        inside = row[:n] == row[size - 1 : size - 1 + n]
        for k in range(size - 1):
            inside &= ~(blank[k : k + n] & blank[k + 1 : k + 1 + n])
        at, of = buckets_of(codes, size)[inside], row[:n][inside]
        for k in range(len(languages)):
            weight = table[k][at]
            total[k] += np.bincount(of, weight, minlength=len(samples)).astype(np.int64)
            known |= np.bincount(of, weight > 0, minlength=len(samples)) > 0
    return [languages[best] if found else "" for best, found in zip(total.argmax(axis=0) if languages else [0] * len(samples), known, strict=True)]


def language_of(profiles: DataFrame) -> Callable[[Column], Column]:
    """A column function: text -> language, '' where no known n-gram occurs. Ties go to the first language by name.

    The weights travel to the tasks once, as a table of fixed size."""
    shared = profiles.sparkSession.sparkContext.broadcast(weight_table(profiles))

    @F.pandas_udf("string")
    def scored(samples: pd.Series) -> pd.Series:
        return pd.Series(score_samples(samples.fillna("").tolist(), *shared.value))

    return lambda text: scored(F.array_join(words_of(text), " "))


def detect_language(samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """page_id, language for samples(page_id, sample)."""
    return samples.select("page_id", language_of(profiles)(F.col("sample")).alias("language"))
