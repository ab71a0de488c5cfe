"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled documents in the tasks, adds them up in Spark and turns the sums into one matrix of
log-probabilities (languages x ``BUCKETS``, so its size does not depend on the data). The matrix is broadcast and whole
texts are scored in batches: a batch is a sparse matrix of unit entries whose rows are summed with ``reduceat``.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing could be
learned. A null language is never learned. Equal posteriors go to the language that sorts first. Repeated rows are
predicted alike. Other columns of the input are kept, whatever their names, except those the caller asks to add.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crawlgrain.llm.common import kept_columns, map_arrow, prepare, read_table, text_slices

BUCKETS = 1 << 15
ORDERS = 3
SMOOTHING = 0.1
#: Bound of the training sample: documents of each language, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 20_000
#: Below this posterior the pipeline treats a text as of no known language.
MIN_SCORE = 0.5
_PIECE = 1 << 20


@functools.cache
def _fold() -> np.ndarray:
    """Code point -> its lower-case form if a letter, else a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def _pieces(texts: list[str]) -> Iterator[tuple[int, str, int]]:
    """(row, characters, n-grams starting in them): long texts come in parts that overlap by what an n-gram needs."""
    for row, text in enumerate(texts):
        text = f" {text}"
        for a in range(0, len(text), _PIECE):
            b = min(len(text), a + _PIECE)
            yield row, text[a : b + ORDERS - 1], b - a


def featurise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids (orders x positions; ``BUCKETS`` where there is no n-gram), start and row of each piece, letters per row."""
    rows, parts, own = zip(*_pieces(texts), strict=True)
    # Each part is padded so that no n-gram reaches into the next one.
    pad = " " * (ORDERS - 1)
    c = _fold()[np.frombuffer((pad.join(parts) + pad).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.array([len(p) for p in parts]) + len(pad)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    n = len(c)
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts] += 1
    inside[starts + np.array(own)] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    letter = c != 32
    after = np.concatenate((letter[1:], [False]))
    h = c * np.uint32(0x9E3779B1)
    out = np.empty((ORDERS, n), dtype=np.uint32)
    valid = (letter, letter | after, after)
    for k in range(ORDERS):
        if k:
            nxt = np.zeros(n, dtype=np.uint32)
            nxt[:-k] = c[k:]
            h = (h ^ nxt) * np.uint32(0x85EBCA6B) + np.uint32(k)
            h ^= h >> np.uint32(15)
        out[k] = np.where(inside & valid[k], (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 15), BUCKETS)
    letters = np.bincount(rows, weights=np.add.reduceat((letter & inside).astype(np.int64), starts), minlength=len(texts))
    return out, starts, np.array(rows), letters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in text_slices(batches):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        found, starts, rows, _ = featurise(texts)
        names = sorted(set(langs))
        index = np.array([names.index(x) for x in langs])
        lengths = np.diff(np.concatenate((starts, [found.shape[1]])))
        base = np.repeat(index[rows], lengths) * (BUCKETS + 1)
        sums = sum(np.bincount(base + f, minlength=len(names) * (BUCKETS + 1)) for f in found)
        for i, name in enumerate(names):
            part = sums[i * (BUCKETS + 1) : (i + 1) * (BUCKETS + 1) - 1]
            totals[name] = totals.get(name, 0) + part
    for name, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()),
            "n": pa.array(counts[at], pa.int64())})


class Model:
    """Languages in order, log-probabilities (one row each, a last column of zeros) and log-priors."""

    def __init__(self, languages: list[str], weights: np.ndarray, priors: np.ndarray):
        self.languages, self.weights, self.priors = languages, weights, priors

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        full = [t or "" for t in texts]
        if not self.languages or not full:
            return names, scores
        found, starts, rows, letters = featurise(full)
        logs = np.empty((len(self.languages), len(texts)))
        for i, weights in enumerate(self.weights):
            sums = sum(np.add.reduceat(weights[f], starts, dtype=np.float64) for f in found)
            logs[i] = np.bincount(rows, weights=sums, minlength=len(texts)) + self.priors[i]
        best = logs.argmax(axis=0)
        posterior = 1 / np.exp(logs - logs.max(axis=0)).sum(axis=0)
        for i in np.flatnonzero(letters):
            names[i], scores[i] = self.languages[best[i]], posterior[i]
        return names, scores


def train(docs: DataFrame, may_learn: Column, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text, lang) that ``may_learn`` allows, at most about ``sample`` a language."""
    rows = docs.select("doc_id", "text", "lang").where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    counts = map_arrow(rows.where(draw < share[F.col("lang")]).select("text", "lang"), _count,
                       "lang string, bucket int, n long")
    sums = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most languages x BUCKETS rows, however large the input.
    got = sums.toPandas()
    languages = sorted(got["lang"].unique())
    weights = np.zeros((len(languages), BUCKETS + 1), dtype=np.float32)
    for i, name in enumerate(languages):
        own = got[got["lang"] == name]
        c = np.full(BUCKETS, SMOOTHING)
        c[own["bucket"].to_numpy()] += own["n"].to_numpy()
        weights[i, :-1] = np.log(c / c.sum())
    priors = np.log(np.array([sizes[x] for x in languages], dtype=float) / sum(sizes[x] for x in languages))
    return Model(languages, weights, priors)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and a struct ``__found`` of lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.priors))

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        known = Model(*shared.value)
        names: list[str] = []
        scores: list[np.ndarray] = []
        for part in text_slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])])):
            a, b = known.predict(part.column("text").to_pylist())
            names += a
            scores.append(b)
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0)})

    prepare(docs.sparkSession)
    return docs.withColumn("__found", score("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a ``text``) plus ``lang_pred`` and ``score``. Existing columns of these names are replaced."""
    kept = [F.col(f"`{c}`") for c in kept_columns(docs, ("lang_pred", "score"))]
    return _scored(docs, model).select(*kept, "__found.lang_pred", "__found.score")


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, remainder() != 2)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents of a recognised language: learned as in the query, those without one are left out."""
    found = _scored(docs, train(docs, remainder() != 2))
    return found.where((F.col("__found.lang_pred") != "und") & (F.col("__found.score") >= min_score)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
