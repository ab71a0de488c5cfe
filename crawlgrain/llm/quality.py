"""Quality rules as a short-circuit cascade.

Every rule looks at one document and may reject it. The cost of each rule and how much it rejects are estimated on a
sample of documents; rules then run in the order of rejection per cost, and a document leaves the cascade at the first
rule that rejects it. A document is kept if no rule rejects it, so the order decides the time and never the outcome.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: a null or blank text has no words and is rejected by ``few_words``.
Texts are read whole; repeated rows are judged alike. An empty sample leaves the rules in their given order. Other
columns of the input are kept; existing columns of the names made here are replaced.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain.llm.common import kept_columns, map_arrow, read_table, text_bytes, text_slices

#: Fixed values of the base counts and rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Documents of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(SYMBOLS)] = True


class Document:
    """One text as bytes; each feature is computed when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @functools.cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @functools.cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.raw, dtype=np.uint8)

    @functools.cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @functools.cached_property
    def n_words(self) -> int:
        return len(self.words)

    @functools.cached_property
    def word_chars(self) -> int:
        """Code points outside white space: bytes that do not continue a character."""
        return int(np.count_nonzero(((self.codes & 0xC0) != 0x80) & ~_SPACES[self.codes]))

    @functools.cached_property
    def n_symbols(self) -> int:
        return int(np.count_nonzero(_MARKS[self.codes]))

    @functools.cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @functools.cached_property
    def n_repeat_words(self) -> int:
        """Words covered by three-word windows that occur twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], dtype=np.int64)
        size = len(number)
        if size == n:
            return 0
        pairs = ids[:-1] * size + ids[1:]
        if size >= 1 << 21:  # three numbers no longer fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(n - 2, dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(np.count_nonzero(covered))

    @functools.cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.raw.decode("utf-8", "replace")))


Rule = Callable[[Document], bool]
#: name -> whether the rule rejects a document. The first two are the base rules.
RULES: dict[str, Rule] = {
    "few_words": lambda d: d.n_words < MIN_WORDS,
    "repeated_words": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "repeated_lines": lambda d: 10 * d.n_dup_lines > 4 * len(d.lines),
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
    "few_letters": lambda d: 10 * d.letters < 7 * d.word_chars,
}


def measure(docs: DataFrame, rules: dict[str, Rule], rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Of each rule, the seconds a document costs and the share it rejects, on about ``rows`` documents of the input."""
    total = docs.count()
    share = min(1.0, rows / total) if total else 0.0
    # Id and text are drawn together: a text, or null, of very many rows is drawn no more often than others.
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    sample = docs.where(drawn < share * 1_000_000).select("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = dict.fromkeys(rules, 0.0)
        rejected = dict.fromkeys(rules, 0)
        seen = 0
        for batch in text_slices(batches):
            for raw in text_bytes(batch.column("text")):
                seen += 1
                for name, rejects in rules.items():
                    start = time.perf_counter()
                    rejected[name] += rejects(Document(raw))
                    spent[name] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict({
            "rule": list(rules), "seconds": list(spent.values()), "rejected": list(rejected.values()),
            "seen": [seen] * len(rules)}, schema=pa.schema([
                ("rule", pa.string()), ("seconds", pa.float64()), ("rejected", pa.int64()), ("seen", pa.int64())]))

    found = map_arrow(sample, work, "rule string, seconds double, rejected long, seen long").groupBy("rule").agg(
        F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("seen").alias("n")).collect()
    return {x.rule: (x.s / x.n, x.r / x.n) for x in found if x.n}


def order_rules(measured: dict[str, tuple[float, float]], rules: dict[str, Rule]) -> list[str]:
    """Rules by rejection per cost, largest first; unmeasured ones and ties stay as given."""
    gain = lambda name: measured[name][1] / max(measured[name][0], 1e-9) if name in measured else 0.0
    return sorted(rules, key=gain, reverse=True)


def cascade(docs: DataFrame, rules: dict[str, Rule] | None = None, counts: tuple[str, ...] = (),
            keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), the ``counts`` asked for, and ``kept``."""
    rules = dict(rules or RULES)
    order = order_rules(measure(docs, rules), rules)
    made = (*counts, "kept")
    keep = [c for c in kept_columns(docs, made) if keep is None or c in keep]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [rules[name] for name in order]
        for batch in text_slices(batches):
            found = [Document(raw) for raw in text_bytes(batch.column("text"))]
            kept = [not any(rejects(d) for rejects in steps) for d in found]
            values = [pa.array([getattr(d, c) for d in found], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *values, pa.array(kept)], [*batch.schema.names[: len(keep)], *made])

    fields = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    done = map_arrow(source, work, ", ".join([*fields, *[f"{c} long" for c in counts], "kept boolean"]))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *made)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cascade(read_table(spark, sf_dir, "documents"), counts=COUNTS, keep=["doc_id"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *COUNTS, failed.alias("base_failed"), "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls FROM d),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
            FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
repeats AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[ \x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(ls) AS n_lines, length(regexp_replace(t, '\PL', '', 'g')) AS letters
      FROM w LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * letters < 7 * word_chars) AS kept
FROM f
"""
