"""Near-duplicate groups by HyperMinHash sketches.

1. One pass hashes each text's word shingles (of ``width`` words) and keeps, per bucket of the hash space, the minimum in compressed form:
   the count of its leading zeros and ten mantissa bits. Empty buckets borrow from others by a fixed random probing.
2. Texts of equal shingle sets collapse to the smallest id; only these representatives go on.
3. Bands of registers are keys (``bands_of``; at 0.85, 32 of four). Within each key every representative is paired with the smallest and
   the largest id: two pairs a row, whatever the size of the group.
4. Pairs pass a bound on set sizes and the collision-corrected Jaccard estimate, then full sets are compared exactly.
5. Links are contracted to components. Keys whose rows are in one component are done. The texts of all other keys are
   compared across components by a prefix filter on their rarest shingles, which is exact: no link between them is lost,
   and no group is written out as pairs.

Bands are as wide as a miss of at most 1e-10 allows: four of 128 registers agree at 0.85 in one band with probability 0.52,
in none of 32 with 6e-11; three of them at 0.8 with 0.51, in none of 42 with 8e-14. ``op1_near_dedup`` takes three words
and 0.85, the pipeline's stage five words and 0.8.

Defined cases: a null text, or one without words, has the empty set and is linked with nothing. Fewer than ``width`` words
are one shingle. Repeated rows share a component, whose id is the smallest in it. A null id gets a null component and is kept;
rows of one id that share their shingles are one class. A very long text is one set, hashed in its task. An empty table gives no
rows. Other columns are not read by ``near_groups`` and pass ``drop_near_copies``, which tells rows of one id apart by their text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from crawlgrain.llm.common import Scratch, map_arrow, mix64, read_table, text_bytes, text_slices, words_of

REGISTERS, MANTISSA = 128, 10
#: Words of a shingle; links need 100 * intersection >= LEAST * union.
WIDTH, LEAST = 3, 85
#: The same for ``drop_near_copies``.
STAGE_WIDTH, STAGE_LEAST = 5, 80
#: Largest probability that a pair at the threshold shares no band.
MISS = 1e-10
#: Pairs estimated this many standard deviations under the threshold are not compared. Small sets always are.
DEVIATIONS, SMALL = 4.75, 48
# A column beside those of the documents.
_HASH = "_hash_of_text"
_PROBES = 192
_BITS = 1 << 23
_PROBE = np.random.default_rng(20240229).integers(0, REGISTERS, size=(_PROBES, REGISTERS))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHash()


def bands_of(least: int) -> tuple[int, int]:
    """Number of bands and registers of each: the widest that miss a pair at the threshold with at most ``MISS``."""
    for size in range(REGISTERS, 1, -1):
        if (1 - (least / 100) ** size) ** (REGISTERS // size) <= MISS:
            return REGISTERS // size, size
    return REGISTERS, 1


def estimate_bound(least: int) -> float:
    share = least / 100
    return math.floor(100 * share - 100 * DEVIATIONS * math.sqrt(share * (1 - share) / REGISTERS)) / 100


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    out = []
    for raw in texts:
        words = words_of(raw)
        h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(width, len(h))
        n = len(h) - size + 1 if size else 0
        s = np.full(n, size, dtype=np.uint64)  # shingles of fewer words are others than those of ``width``
        for i in range(size):
            s += h[i : i + n] * factors[i]
        out.append(np.unique(mix64(s)))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set: leading zeros + 1 above the mantissa of the least hash in each bucket; 0 for no hash."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), sizes)
    bucket = (values >> np.uint64(57)).astype(np.int64)
    place = rows * REGISTERS + bucket
    first = np.flatnonzero(np.diff(place, prepend=-1))  # sets are sorted, so the least hash comes first
    part, exponent = np.frexp((values[first] << np.uint64(7)).astype(np.float64))
    zeros = np.minimum(64 - exponent, 62)
    mantissa = np.minimum(((2 * part - 1).clip(0) * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    out.reshape(-1)[place[first]] = ((zeros + 1) << MANTISSA | mantissa).astype(np.uint16)
    # Borrowing: the probes are the same for all sets, and only buckets that were filled at first are lenders.
    todo = np.flatnonzero(sizes)
    lenders = out.copy()
    for probe in _PROBE:
        todo = todo[(out[todo] == 0).any(axis=1)]
        if not len(todo):
            return out
        own = out[todo]
        out[todo] = np.where(own == 0, lenders[todo][:, probe], own)
    while len(todo := todo[(out[todo] == 0).any(axis=1)]):  # very few buckets: the next filled one to the left
        own = out[todo]
        out[todo] = np.where(own == 0, np.roll(own, 1, axis=1), own)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of paired sketches, corrected for agreement by chance.

    Registers of different minima agree if their zeros do and their mantissas do: the share of equal counts expected from
    the two sketches' own distributions, times 2 ** -MANTISSA.
    """
    equal = (a == b).mean(axis=1)
    rows = np.arange(len(a))[:, None] * 64
    share = lambda x: np.bincount((rows + (x >> MANTISSA)).ravel(), minlength=64 * len(x)).reshape(-1, 64) / REGISTERS
    chance = (share(a) * share(b)).sum(axis=1) / (1 << MANTISSA)
    return (equal - chance) / (1 - chance)


def _sketch(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(text_bytes(batch.column("text")), width)
            registers = sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([r.tobytes() for r in registers], pa.binary())], ["doc_id", "text_hash", "n", "digest", "sketch"])
        _WORDS.clear()

    return work


def _near(bound: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            small = np.asarray(batch.column("least")) < SMALL
            yield batch.select(["a", "b"]).filter(pa.array((estimate(a, b) >= bound) | small))

    return work


def _sets_of(bits, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in text_slices(batches):
            ids = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)
            at = ids % _BITS
            hit = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            if hit.any():
                part = batch.filter(pa.array(hit))
                sets = shingle_sets(text_bytes(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 ["node", "set"])
        _WORDS.clear()

    return work


def _confirm(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * common >= least * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return work


def _id_bits(ids: DataFrame) -> bytes:
    """A bit table of fixed size at the ids' remainders: it spares most rows, and joins on the ids stay exact."""
    at = f"pmod(node, {_BITS})"
    words = ids.selectExpr(f"{at} DIV 32 AS word", f"shiftleft(1L, CAST({at} % 32 AS INT)) AS bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(_BITS // 32, dtype="<u4")
    table[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return table.tobytes()


def components(links: DataFrame, work: Scratch, name: str) -> DataFrame:
    """node, label: the smallest id that ``links`` (a, b) connect with each node, by repeated contraction."""
    links, labels, step = work.write(links.select("a", "b"), f"{name}-links0"), None, 0
    while not links.isEmpty():
        ends = links.union(links.select("b", "a")).toDF("node", "other")
        parent = ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
        parent = work.write(parent, f"{name}-parent{step}")
        above = parent.toDF("label", "above")
        parent = work.write(parent.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), f"{name}-jump{step}")
        if labels is None:
            merged = parent
        else:
            merged = labels.toDF("start", "node").join(parent, "node", "left").select(
                F.col("start").alias("node"), F.coalesce("label", "node").alias("label"))
        labels = work.write(merged, f"{name}-labels{step}")
        left = links.join(parent.toDF("a", "la"), "a").join(parent.toDF("b", "lb"), "b")
        links = work.write(left.where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(),
                           f"{name}-links{step + 1}")
        work.drop(f"{name}-parent{step}", f"{name}-jump{step}", f"{name}-links{step}", *([f"{name}-labels{step - 1}"] if step else []))
        step += 1
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))


class _Linker:
    """Confirms candidate pairs of representatives against the texts."""

    def __init__(self, docs: DataFrame, reps: DataFrame, work: Scratch, width: int, least: int):
        self.texts, self.reps, self.work, self.width, self.least = docs.select("doc_id", "text"), reps, work, width, least

    def sets(self, nodes: DataFrame) -> DataFrame:
        bits = nodes.sparkSession.sparkContext.broadcast(_id_bits(nodes))
        found = map_arrow(self.texts, _sets_of(bits, self.width), "node long, set binary")
        return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        side = lambda x: self.reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {self.least} * greatest(na, nb)").select(
            "a", "b", F.least("na", "nb").alias("least"), "sa", "sb")
        near = self.work.write(map_arrow(both, _near(estimate_bound(self.least)), "a long, b long"), f"{name}-near")
        sets = self.work.write(self.sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct()), f"{name}-sets")
        full = near.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
        links = self.work.write(map_arrow(full, _confirm(self.least), "a long, b long"), f"{name}-confirmed")
        self.work.drop(f"{name}-near", f"{name}-sets")
        return links


def near_groups(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Shingles are of ``width`` words; texts are linked from a similarity of ``least`` hundredths on.
    """
    return _grouped_rows(docs, width, least).drop("text_hash", "digest")


def _grouped_rows(docs: DataFrame, width: int, least: int) -> DataFrame:
    """The rows of ``near_groups`` with a hash of the text and the digest of the shingle set."""
    work = Scratch(docs.sparkSession, "near-dedup")
    found = work.write(map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), _sketch(width),
                                 f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n long, digest binary, sketch binary"),
                       "sketches")
    smallest = work.write(found.where("n > 0").groupBy("digest").agg(F.min("doc_id").cast("long").alias("node")), "smallest")
    reps = work.write(found.withColumn("node", F.col("doc_id").cast("long")).join(smallest, ["digest", "node"]).select("node", "n", "sketch"), "reps")
    bands, size = bands_of(least)
    keys = reps.selectExpr("node", f"explode(transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sketch, {2 * size} * i + 1, {2 * size})))) AS key")
    keys = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").join(keys, "key")
    keys = work.write(keys.select("key", "node", "lo", "hi"), "keys")
    linker = _Linker(docs, reps, work, width, least)
    pairs = keys.selectExpr("lo AS a", "node AS b").union(keys.selectExpr("node AS a", "hi AS b")).where("a < b").distinct()
    links = linker.confirm(pairs, "first")
    labels = components(links, work, "first")
    # Keys that still hold more than one component.
    labelled = keys.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    labelled = work.write(labelled, "labelled")
    split = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    open_rows = work.write(labelled.join(split, "key"), "open")
    work.drop("keys", "labelled")
    nodes = open_rows.select("node", "label").distinct()
    grams = linker.sets(nodes.select("node")).selectExpr("node", f"explode({_longs_sql('set')}) AS gram")
    grams = work.write(grams, "grams")
    # Prefix filter: of two linked sets, the rarest shingles up to n - least n + 1 have one in common, and behind the first
    # common one enough must be left. Shingles of one text count in the place of the others and match nothing.
    ranked = grams.join(grams.groupBy("gram").agg(F.count("*").alias("texts")), "gram").withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy("texts", "gram")))
    rows = ranked.where("texts > 1").join(nodes, "node").join(reps.select("node", "n"), "node").where(
        f"place <= n - ({least} * n + 99) DIV 100 + 1").select("gram", "node", "label", "n", "place")
    rows = work.write(rows, "rows")
    work.drop("grams", "open")
    mixed = rows.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("gram")
    rows = rows.join(mixed, "gram")
    side = lambda x: rows.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "place")])
    more = side("a").join(side("b"), "gram").where(
        f"node_a < node_b AND label_a != label_b AND 100 * least(n_a, n_b) >= {least} * greatest(n_a, n_b) "
        f"AND {100 + least} * (1 + least(n_a - place_a, n_b - place_b)) >= {least} * (n_a + n_b)"
    ).selectExpr("node_a AS a", "node_b AS b").distinct()
    later = linker.confirm(more, "second")
    work.drop("rows")
    name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    joined = later.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = components(joined.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), work, "second")
    final = smallest.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("node")).join(
        top, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    own = F.col("doc_id").cast("long")
    return found.select("doc_id", "text_hash", "n", "digest").join(final, "digest", "left").select(
        "doc_id", "text_hash", "digest", F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"),
        own.eqNullSafe(F.coalesce("component_id", own)).alias("kept"))


def _longs_sql(column: str) -> str:
    """The 8-byte words of a binary column."""
    return f"transform(sequence(0, length({column}) DIV 8 - 1), i -> xxhash64(substring({column}, 8 * i + 1, 8)))"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), WIDTH, LEAST)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without those in the group of a smaller id. Of rows with one id and the same shingles one stays; rows of that id
    with other texts have their own fate. Rows without words or id all stay."""
    work = Scratch(docs.sparkSession, "near-copies")
    rows = work.write(_grouped_rows(docs, STAGE_WIDTH, STAGE_LEAST).select("doc_id", "text_hash", "digest", "kept", "n_shingles"), "rows")
    gone = rows.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    again = rows.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(
        F.min("text_hash").alias("best"), F.count("*").alias("rows")).where("rows > 1")
    other = rows.join(again, ["doc_id", "digest"]).where("text_hash != best").select("doc_id", "text_hash").distinct()
    hashed = docs.withColumn(_HASH, F.xxhash64("text"))
    # Only the few rows that still occur more than once are compared as whole rows. As a written table their size is known, so
    # texts need not be shuffled for them; they are once, to leave out the others.
    twice = work.write(again.select("doc_id", F.col("best").alias(_HASH)).distinct(), "twice")
    out = gone.unionByName(other).withColumnRenamed("text_hash", _HASH).unionByName(twice)
    one = hashed.join(twice, ["doc_id", _HASH], "left_semi").dropDuplicates(["doc_id", _HASH])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = hashed.join(out, ["doc_id", _HASH], "left_anti")
    return left.select(*columns).unionByName(one.select(*columns))
