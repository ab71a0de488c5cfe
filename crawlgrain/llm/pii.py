"""Personal data: pattern spans, and terms that give protected values away by what the corpus says about them.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Each value found is a protected entity.
Terms (runs of letters, of any length) near an entity are counted over the corpus: of the documents that hold a term, the share in which
it stands near the entity is its disclosure, and its logarithm over the entity's own share the information in bits. Terms
whose disclosure, information and number of different contexts reach the thresholds become spans wherever they occur;
``sanitise`` removes the strongest and replaces the others, and the base spans, by their kind.

All counts cover all documents. What is broadcast is a bit table of fixed size that spares most terms the shuffle; what
passes it is joined exactly, so more revealing terms mean more rows in the join and never a different answer.

Defined cases: a null text counts as empty and has no spans. Texts are read whole. Repeated rows (same id and text) get
the same spans. Terms inside a base span are no spans of their own. Ties of spans go by start, then kind, then end.
Without documents, or without entities, only base spans remain. Other columns pass ``sanitise`` unchanged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain.llm.common import Scratch, map_arrow, read_table, text_slices

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of a span that count as near it.
NEAR = 8
#: Least share of a term's documents, bits of information and different contexts for a term to reveal an entity.
DISCLOSURE, BITS, CONTEXTS = 0.5, 4.0, 3
#: From this disclosure on a term is removed; below it is replaced by its kind.
REMOVED_FROM = 0.9
#: Size of the broadcast bit table.
TABLE_BITS = 1 << 23

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting at the first digit of a run only, and never giving digits back, keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern would match, but from each ``@`` to the left, so that long words cost their length once."""
    end = at = 0
    while found := _DOMAIN.search(text, at):
        start = found.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            yield start, found.end()
            end = at = found.end()
        else:
            at = found.start() + 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base spans, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    start, kind, end = span
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _digits(value)}"


def _terms_around(text: str, start: int, end: int) -> list[str]:
    """The ``NEAR`` words before and after a span, as terms; words are what blanks separate, however long."""
    size = 64 * NEAR
    # One word more than wanted, or the text's end, shows that no wanted word is cut.
    while len(before := text[max(0, start - size) : start].split()) <= NEAR and size < start:
        size *= 2
    size = 64 * NEAR
    while len(after := text[end : end + size].split()) <= NEAR and end + size < len(text):
        size *= 2
    return [t.lower() for t in _TERM.findall(" ".join(before[-NEAR:] + after[:NEAR]))]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, hash of the context) once for each document."""
    for batch in text_slices(batches):
        rows: dict[tuple[int, str, str], int] = {}
        for i, text in enumerate(batch.column("text").to_pylist()):
            for span in base_spans(text or ""):
                near = _terms_around(text, span[0], span[2])
                context = zlib.crc32(" ".join(near).encode("utf-8", "surrogatepass"))
                for key in ((i, entity(text, span), t) for t in near):
                    rows[key] = min(context, rows.get(key, context))
        yield pa.RecordBatch.from_pydict({
            "entity": pa.array([r[1] for r in rows], pa.string()), "term": pa.array([r[2] for r in rows], pa.string()),
            "context": pa.array(list(rows.values()), pa.int64())})


class TermTable:
    """Bits at the hashes of some terms: no term of the table is missed, few others pass."""

    def __init__(self, bits: bytes):
        self.bits, self.seen = np.frombuffer(bits, dtype=np.uint8), {}

    def __contains__(self, term: str) -> bool:
        known = self.seen.get(term)
        if known is None:
            at = zlib.crc32(term.encode("utf-8", "surrogatepass")) % TABLE_BITS
            known = bool(self.bits[at >> 3] >> (at & 7) & 1)
            if len(self.seen) > 150_000:
                self.seen.clear()
            self.seen[term] = known
        return known


def term_bits(terms: DataFrame) -> bytes:
    """The bit table of a ``term`` column; at most ``TABLE_BITS / 32`` rows reach the driver, however many terms."""
    at = f"crc32(term) % {TABLE_BITS}"
    words = terms.selectExpr(f"({at}) DIV 32 AS word", f"shiftleft(1L, CAST(({at}) % 32 AS INT)) AS bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(TABLE_BITS // 32, dtype="<u4")
    table[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return table.tobytes()


def _count_terms(bits):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable(bits.value)
        for batch in text_slices(batches):
            counts: dict[str, int] = {}
            for text in batch.column("text").to_pylist():
                for term in {t.lower() for t in set(_TERM.findall(text or ""))}:
                    if term in table:
                        counts[term] = counts.get(term, 0) + 1
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return work


def revealing_terms(docs: DataFrame, work: Scratch) -> DataFrame:
    """term, disclosure, bits, entity: each term that reveals an entity, with the one it reveals most."""
    texts = docs.select("text").where(F.col("text").isNotNull())
    seen = map_arrow(texts, _contexts, "entity string, term string, context long")
    pairs = seen.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("both"), F.count("*").alias("contexts"))
    pairs = work.write(pairs.where(F.col("contexts") >= CONTEXTS), "pairs")
    bits = docs.sparkSession.sparkContext.broadcast(term_bits(pairs.select("term")))
    counts = map_arrow(texts, _count_terms(bits), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = docs.count()
    # An entity's own share is at least that of its most frequent companion.
    shares = pairs.groupBy("entity").agg((F.max("both") / F.lit(max(total, 1))).alias("share"))
    found = pairs.join(counts, "term").join(shares, "entity").select(
        "term", "entity", (F.col("both") / F.col("n")).alias("disclosure"),
        F.log2(F.col("both") / F.col("n") / F.col("share")).alias("bits"))
    return found.where((F.col("disclosure") >= DISCLOSURE) & (F.col("bits") >= BITS)).groupBy("term").agg(
        F.max_by(F.struct("disclosure", "bits", "entity"), F.struct("disclosure", "entity")).alias("m")).select("term", "m.*")


def _find(bits):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable(bits.value)
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
        term = pa.struct([("term", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        for batch in text_slices(batches):
            spans, terms = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                own = base_spans(text)
                spans.append([dict(zip(("start", "kind", "stop"), x, strict=True)) for x in own])
                words = {t for t in set(_TERM.findall(text)) if t.lower() in table}
                found = []
                if words:
                    for m in _TERM.finditer(text):
                        if m[0] in words and not any(a < m.end() and m.start() < b for a, _, b in own):
                            found.append({"term": m[0].lower(), "start": m.start(), "stop": m.end()})
                terms.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(terms, pa.list_(term))],
                ["row", "doc_id", "base", "terms"])

    return work


def _row_key() -> F.Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))


def find_spans(docs: DataFrame, work: Scratch) -> DataFrame:
    """row (a key of id and text), doc_id, base and spans (arrays of start, kind, stop; kind 4: a term, 5: to be removed)."""
    terms = work.write(revealing_terms(docs, work), "terms")
    bits = docs.sparkSession.sparkContext.broadcast(term_bits(terms.select("term")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = work.write(map_arrow(docs.select(_row_key().alias("row"), "doc_id", "text"), _find(bits),
                                 f"row string, doc_id {kind}, base array<struct<start:int,kind:int,stop:int>>, "
                                 "terms array<struct<term:string,start:int,stop:int>>"), "found")
    hits = found.select("row", F.explode("terms").alias("t")).select("row", "t.*").join(
        terms.select("term", "disclosure"), "term").groupBy("row").agg(F.collect_set(F.struct(
            "start", F.when(F.col("disclosure") >= REMOVED_FROM, 5).otherwise(4).alias("kind"), "stop")).alias("more"))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return found.join(hits, "row", "left").select(
        "row", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", empty))).alias("spans"))


def _as_text(spans: str) -> F.Column:
    names = ", ".join(f"'{k}'" for k in (*KINDS, KINDS[-1]))
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.stop)), ',')")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {i})) AS LONG) AS n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(_as_text("base"), 256).alias("base_sha256"), _as_text("spans").alias("spans"))


def replace_spans(text: str, spans: list) -> str:
    """``text`` without its spans: kinds stand for values; where spans overlap, the earlier one decides."""
    out, at = [], 0
    for s in spans:
        start, kind, stop = s["start"], s["kind"], s["stop"]
        if start >= at:
            out += [text[at:start], "" if kind == 5 else f"[{KINDS[kind].upper()}]"]
            at = stop
        elif stop > at:
            at = stop  # the rest of an overlapping span goes with the first
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` removed or generalised; ``n_chars``, where there is one, follows the text."""
    found = find_spans(docs, Scratch(docs.sparkSession, "pii")).where(F.size("spans") > 0)
    # Rows of equal id and text have equal spans: one of them is enough for the join.
    found = found.groupBy(F.col("row").alias("__row")).agg(F.first("spans").alias("__spans"))

    @F.pandas_udf("string")
    def clean(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None or t is None else replace_spans(t, s))

    joined = docs.withColumn("__row", _row_key()).join(found, "__row", "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean("text", "__spans"))
    columns = [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`")
               for c in docs.columns]
    return joined.select(*columns)
