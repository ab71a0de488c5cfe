"""Source divergence audit: how far the term distribution of each source lies from that of other sources and of its language.

Tokenizer: one ``bytes.translate`` lowers A-Z and blanks separators, ``bytes.split`` cuts the terms and a ``Counter`` per
document gives frequencies. A task adds them up per (language, source) and sends sparse (term, frequency, documents) rows,
which Spark adds up per term. Kept are the terms in at least ``LEAST_DOCS`` documents of a language. Each group then has a
smoothed share ``p`` of every kept term as an integer in billionths, so all sums are exact.

Pairs: terms are dealt out in blocks by a hash. A block turns its sparse cells into a matrix (terms x sources), absent ones at
the source's base share, and sums the distances of its columns; Spark adds the blocks up. More than ``TILE`` sources of a
language are compared tile by tile. The pairs themselves are the result asked for: each source with each other.

Defined cases: null text, language or source count as the empty string. A document is a row, so repeated rows count each time.
A group without kept terms has the base share of each; without any kept term all distances are 0 and no term is listed. Equal
values go by the item's UTF-8 bytes. A very long text is cut in pieces at separators. No rows give no rows. Other columns of the
table, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crawlgrain.llm.common import Scratch, map_arrow, read_table, text_bytes, text_slices

LEAST_DOCS = 30
TOP_TERMS = 50
#: Shares are whole billionths; each kept term counts ``PRIOR`` times more than it occurs.
SCALE, PRIOR = 1_000_000_000, 5
#: Cells of a block on average, and sources compared at once.
BLOCK_CELLS, TILE = 20_000, 512
# Bytes of text split at once, and counters of a task before they are sent on.
PIECE, HELD = 1 << 20, 200_000
# Entries of one matrix.
_MATRIX = 1 << 21

#: Byte -> itself, lowered, or a blank: letters and all bytes beyond ASCII make up terms.
TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(raw: bytes | None) -> Counter[bytes]:
    """Term -> frequency in one text."""
    clean = (raw or b"").translate(TABLE)
    if len(clean) <= PIECE:
        return Counter(clean.split())
    found, start = Counter(), 0
    while start < len(clean):
        stop = clean.find(b" ", start + PIECE)
        stop = len(clean) if stop < 0 else stop
        found.update(clean[start:stop].split())
        start = stop
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def sent():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                 pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in text_slices(batches):
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, raw in zip(groups, text_bytes(batch.column("text")), strict=True):
            found = count_terms(raw)
            n, docs = held.setdefault(group, (Counter(), Counter()))
            size -= len(n)
            n.update(found)
            docs.update(found.keys())
            size += len(n)
        if size > HELD:
            yield from sent()
            size = 0
    yield from sent()


def term_cells(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n (occurrences), lang_n (those in the language) and first (one row a term) of kept terms."""
    texts = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = map_arrow(texts, _count, "lang string, source string, term string, n long, docs long")
    # One shuffle by term: sums, document counts and totals of a term are all found where its rows meet.
    cells = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return cells.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("first")).where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms))``, exact for counts of up to 20 digits."""
    part = F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + F.lit(PRIOR).cast("decimal(1,0)")).cast("decimal(21,0)")
    whole = (total.cast("decimal(20,0)") + (F.lit(PRIOR) * terms).cast("decimal(20,0)")).cast("decimal(21,0)")
    return F.lit(1).cast("long") + F.call_function("div", part, whole)


def groups_of(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Each (lang, source) with its occurrences of kept terms, the language's, the number of kept terms and its base share."""
    every = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    zero = {"total": 0, "lang_total": 0, "terms": 0}
    found = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(zero)
    return found.withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0))


def _distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block's terms of |p - q| for the sources of tile ``a`` against those of tile ``b``; ``seen`` terms that any of
    them has. On all other kept terms the two lie ``gap`` apart, the distance of their base shares."""
    a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    groups = rows[rows["term"].isna()]
    names = groups["source"].to_numpy()
    tile, base = groups["tile"].to_numpy(), groups["p"].to_numpy(dtype=np.int64)
    cells = rows[rows["term"].notna()]
    term, _ = pd.factorize(cells["term"])
    column = pd.Index(names).get_indexer(cells["source"])
    p = cells["p"].to_numpy(dtype=np.int64)
    order = np.argsort(term, kind="stable")
    term, column, p = term[order], column[order], p[order]
    left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    n_terms = int(term[-1]) + 1 if len(term) else 0
    step = max(1, _MATRIX // max(1, len(names)))
    for start in range(0, n_terms, step):
        lo, hi = np.searchsorted(term, (start, start + step))
        matrix = np.tile(base, (min(step, n_terms - start), 1))
        matrix[term[lo:hi] - start, column[lo:hi]] = p[lo:hi]
        others = matrix[:, right]
        for k, c in enumerate(left):
            total[k] += np.abs(others - matrix[:, c : c + 1]).sum(axis=0)
    one, two = np.meshgrid(left, right, indexing="ij")
    unlike = one != two
    one, two, value = one[unlike], two[unlike], total[unlike]
    if a != b:
        one, two, value = np.concatenate((one, two)), np.concatenate((two, one)), np.concatenate((value, value))
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": names[one], "item": names[two], "value": value,
                         "gap": np.abs(base[one] - base[two]), "seen": n_terms})


def pair_distances(groups: DataFrame, cells: DataFrame, blocks: int, tiles: int) -> DataFrame:
    """lang, source, item (another source of the language), value: the summed distance over all kept terms.

    ``cells`` carry ``p``. A kept term that no document of either source has counts with both base shares."""
    langs = groups.select("lang", "terms").distinct()
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    wide = groups.select("lang", "source", tile.alias("tile"), F.lit(None).cast("string").alias("term"), F.col("base").alias("p"),
                         every.alias("block"))
    rows = wide.unionByName(cells.select("lang", "source", tile.alias("tile"), "term", "p", block.alias("block")))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    rows = rows.withColumn("other", other).select(
        "lang", "source", "tile", "term", "p", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    parts = rows.groupBy("lang", "block", "a", "b").applyInPandas(
        _distances, "lang string, source string, item string, value long, gap long, seen long")
    sums = parts.groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.max("gap").alias("gap"), F.sum("seen").alias("seen"))
    rest = (F.col("terms") - F.col("seen")) * F.col("gap")
    return sums.join(langs, "lang").select("lang", "source", "item", (F.col("value") + rest).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_cells: int = BLOCK_CELLS,
          tile: int = TILE) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank; see the module for what they mean."""
    work = Scratch(docs.sparkSession, "divergence")
    cells = work.write(term_cells(docs, least_docs), "cells")
    groups = work.write(groups_of(docs, cells), "groups")
    n_cells = cells.count()
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1

    shares = groups.select("lang", "source", "total", "lang_total", "terms")
    valued = cells.join(shares, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    pairs = pair_distances(groups, valued, -(-n_cells // block_cells) or 1, -(-widest // tile))
    terms = valued.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of a language by distance, and the terms that stand out most in each source."""
    return audit(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = rf"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t, row_number() OVER () AS row_no
    FROM documents),
found AS (
    SELECT row_no, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM docs),
kept AS (
    SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT row_no) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
every AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
    SELECT e.lang, e.source, k.term, coalesce(c.n, 0) AS n, k.lang_n
    FROM every e JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = e.lang AND c.source = e.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
shares AS (
    SELECT d.lang, d.source, d.term, d.n,
           1 + ({SCALE}::HUGEINT * (d.n + {PRIOR})) // (t.total + {PRIOR} * l.v) AS p,
           1 + ({SCALE}::HUGEINT * (d.lang_n + {PRIOR})) // (l.lang_total + {PRIOR} * l.v) AS q
    FROM dense d JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
summed AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
items AS (
    SELECT * FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
