"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment.

An item of m characters occurs in a document if some part of it is within k = m * EDITS // 100 edits. Such a part shares
at least m - Q + 1 - k * Q of the item's q-grams, on k + 1 neighbouring diagonals (place in the text minus place in the
item). Shared q-grams are counted in bands of twice that width, each overlapping the next by half, so one band holds all
of them. Bands that reach the bound are verified by an alignment confined to their diagonals.

Texts and items are compared in lower case with every run of white space as one space. The items are sent to the tasks in
blocks of at most about ``BLOCK_CHARS`` characters; each block is one pass over the documents. Shared q-grams are counted for
the pairs of text and item that have any, so memory follows the hits and not texts times items.

An item longer than two passages of ``PASSAGE`` characters is sought as passages that overlap by half, each with its own edit
budget: a document that quotes a part of it is found. Items shorter than ``Q`` characters are sought as they are, as whole words.

Defined cases: null or empty texts hold nothing, null and empty items occur nowhere. For short items k is lowered until the
bound is one q-gram at least. Repeated rows and repeated items each give their own row; of the passages of an item the one with
the least edits counts. Texts are searched whole, a very long one in a slice of its own. Empty tables give no rows. Other columns
are not read by ``find_items`` and pass ``drop_contaminated``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain.llm.common import map_arrow, read_table, text_slices

Q = 8
#: Edit budget in hundredths of an item's length.
EDITS = 10
BLOCK_CHARS = 1 << 22
#: Characters of a passage of a long item.
PASSAGE = 256
_TABLE = 20
_HITS = 1 << 21
# Texts worked on at once: what numpy makes of so many characters stays in a core's cache.
_SLICE = 1 << 17
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@functools.cache
def _fold() -> np.ndarray:
    """Code point -> lower-case code point; white space -> 32."""
    table = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x30000):
        ch = chr(cp)
        low = ch.lower()
        table[cp] = 32 if ch.isspace() else ord(low) if len(low) == 1 else cp
    return table


def fold(text: str) -> np.ndarray:
    """Compared characters of a text: lower case, one space for each run of white space, none at the ends."""
    c = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = c == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    c = c[keep]
    if len(c) and c[0] == 32:
        c = c[1:]
    return c[:-1] if len(c) and c[-1] == 32 else c


def grams(c: np.ndarray) -> np.ndarray:
    """Hashes of the q-grams at each place (``Q`` is eight: three doublings)."""
    if len(c) < Q:
        return np.zeros(0, dtype=np.uint64)
    h = c.astype(np.uint64)
    for step, k in ((1, _K[0]), (2, _K[1]), (4, _K[2])):
        h = h[:-step] * k + h[step:]
    return h * _K[3]


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> int:
    """Least edits of ``item`` against a part of ``text`` on the diagonals low - k .. high + k, or k + 1 if more than k."""
    first, width = low - k, high - low + 2 * k + 1
    places = np.arange(width) + first
    steps = np.arange(width)
    far = np.int64(1 << 40)
    inside = np.full(len(item) + width, -1, dtype=np.int64)  # the text along the band, -1 outside of it
    a, b = max(0, first), min(len(text), first + len(item) + width)
    if a < b:
        inside[a - first : b - first] = text[a:b]
    cost = np.where((places >= 0) & (places <= len(text)), 0, far)
    for i, sign in enumerate(item.tolist()):
        here = inside[i : i + width]
        new = cost + (here != sign)  # a place outside of the text matches nothing
        new[here < 0] = far
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)  # without this character of the item
        new = np.minimum.accumulate(new - steps) + steps  # with more characters of the text
        if new.min() > k:
            return k + 1
        cost = new
    return min(int(cost.min()), k + 1)


def passages(codes: np.ndarray) -> list[np.ndarray]:
    """A folded item, or its overlapping passages if it is long."""
    if len(codes) <= 2 * PASSAGE:
        return [codes]
    starts = [*range(0, len(codes) - PASSAGE, PASSAGE // 2), len(codes) - PASSAGE]
    return [codes[a : a + PASSAGE] for a in starts]


class Items:
    """A block of items with the index of their q-grams. ``ids`` are those of the passages that are sought."""

    def __init__(self, ids: list, texts: list[str]):
        folded = [(i, part) for i, text in enumerate(texts) for part in passages(fold(text))]
        self.short = [(i, c) for i, c in folded if 0 < len(c) < Q]
        used = [(i, c) for i, c in folded if len(c) >= Q]
        self.every = ids
        self.ids, self.codes = [i for i, _ in used], [c for _, c in used]
        self.lengths = np.array([len(c) for c in self.codes], dtype=np.int64)
        # At least one q-gram must be left: length - Q + 1 - k * Q >= 1.
        self.budget = np.minimum(self.lengths * EDITS // 100, (self.lengths - Q) // Q)
        self.bound = self.lengths - Q + 1 - self.budget * Q
        found = [grams(c) for c in self.codes]
        sizes = np.array([len(g) for g in found], dtype=np.int64)
        every = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
        place = (np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        order = np.argsort(every)
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE, dtype=bool)
        self.table[(self.grams >> np.uint64(64 - _TABLE)).astype(np.int64)] = True

    def bands(self, h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(doc, item, band) of the bands that reach their item's bound. ``doc``: row of each place; ``start``: of each row."""
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE)).astype(np.int64)])
        where = np.searchsorted(self.grams, h[at])
        same = self.grams[np.minimum(where, len(self.grams) - 1)] == h[at]
        at, where = at[same], where[same]
        row = doc[at]
        ends = np.cumsum(self.count[where])
        n_items, span = len(self.ids), len(h) + int(self.lengths.max()) + 2
        # A document with too few shared q-grams of an item has no band with enough of them.
        pairs = _added_up([np.unique(self._pairs(row[a:b], where[a:b], n_items)[0], return_counts=True) for a, b in _cuts(ends, _HITS)])
        likely = pairs[0][pairs[1] >= self.bound[pairs[0] % n_items]]
        if not len(likely):
            return np.zeros((3, 0), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _cuts(ends, _HITS):
            pair, entry, n = self._pairs(row[a:b], where[a:b], n_items)
            use = likely[np.minimum(np.searchsorted(likely, pair), len(likely) - 1)] == pair
            if use.any():
                entry, pair = entry[use], pair[use]
                item = self.item[entry]
                diagonal = np.repeat(at[a:b] - start[row[a:b]], n)[use] - self.place[entry]
                # Bands are counted from 1, so that the one below is never negative.
                key = pair * span + (diagonal + self.lengths[item]) // (self.budget[item] + 1) + 1
                parts.append(np.unique(np.concatenate((key, key - 1)), return_counts=True))
        if not parts:
            return np.zeros((3, 0), dtype=np.int64)
        key, count = _added_up(parts)
        pair, band = key // span, key % span - 1
        found = np.stack((pair // n_items, pair % n_items, band))
        return found[:, count >= self.bound[found[1]]]

    def _pairs(self, row: np.ndarray, where: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each shared q-gram its pair of row and item and its index entry; and how many entries each place has."""
        entry, n = self._entries(where)
        return np.repeat(row, n) * n_items + self.item[entry], entry, n

    def _entries(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index entries of q-grams, and how many each has. At most ``_HITS`` beyond those of one q-gram."""
        n = self.count[where]
        return np.repeat(self.first[where] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(row, item, edits) of all items that occur in the texts; of an item's passages the one with the least edits."""
        codes = [fold(t or "") for t in texts]
        best = {(row, item): 0 for row, item in self._search_short(codes)}
        for row, part, edits in self._search_long(codes) if self.ids else ():
            item = self.ids[part]
            best[row, item] = min(edits, best.get((row, item), edits))
        return [(row, item, edits) for (row, item), edits in best.items()]

    def _search_short(self, codes: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(row, item) of items too short for a q-gram that stand in a text as whole words."""
        if not self.short:
            return
        whole = [c.tobytes().decode("utf-32-le", "surrogatepass") for c in codes]
        for item, c in self.short:
            sought = re.compile(r"(?<!\w)" + re.escape(c.tobytes().decode("utf-32-le", "surrogatepass")) + r"(?!\w)")
            for row, text in enumerate(whole):
                if sought.search(text):
                    yield row, item

    def _search_long(self, codes: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(row, passage, edits)."""
        # A zero ends each text: no q-gram across it is in the index, as folded items hold none of their own there.
        whole = np.concatenate([x for c in codes for x in (c, np.zeros(Q, dtype=np.uint32))])
        sizes = np.array([len(c) + Q for c in codes], dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        rows, items, bands = self.bands(grams(whole), np.repeat(np.arange(len(codes)), sizes), start)
        best: dict[tuple[int, int], int] = {}
        for row, item, band in zip(rows.tolist(), items.tolist(), bands.tolist(), strict=True):
            k = int(self.budget[item])
            done = best.get((row, item), k + 1)
            if done == 0:
                continue
            low = band * (k + 1) - int(self.lengths[item])
            edits = aligned(self.codes[item], codes[row], low, low + 2 * k + 1, k)
            if edits < done:
                best[row, item] = edits
        return [(row, item, edits) for (row, item), edits in best.items()]


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the sums of their counts."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _cuts(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


def find_items(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits: each item that occurs in each row of ``docs``."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-chars // block_chars))
    numbered = items.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {blocks})"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        # Bounded by block_chars (or by one longer item), however large the benchmark.
        own = numbered.where(F.col("block") == block).select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([r.item_id for r in own], [r.text for r in own]))
        part = map_arrow(docs.select("doc_id", "text"), _search(shared), f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long")
        found = part if found is None else found.unionAll(part)
    return found


def _search(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        for batch in text_slices(batches, _SLICE):
            hits = items.search(batch.column("text").to_pylist())
            if hits:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([h[0] for h in hits])), pa.array([items.every[h[1]] for h in hits]),
                     pa.array([h[2] for h in hits], pa.int64())], ["doc_id", "item_id", "edits"])

    return work


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows of any id in whose text an item occurs."""
    hit = find_items(docs, benchmark).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
