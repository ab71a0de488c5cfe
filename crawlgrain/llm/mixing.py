"""Mixing sources to target weights in fixed-length blocks.

``pack`` lines the documents of a source up by id and cuts the stream of their words into blocks of ``BLOCK_WORDS``. ``plan``
gives each source its target and the number of block slots that reach it. ``draw`` deals the slots out to output shards by a
multinomial draw per shard; slot numbers of a source go through a pseudorandom permutation of its own, which says the pass and,
through one more permutation per pass, the block. ``mix`` joins slots and blocks by block index.

Multinomial counts scatter about their mean, so slots drawn beyond a source's number are handed to the sources that got too
few; the permutation picks them evenly over all shards. Thus a source is taken to within a word of its target, and a document at
most three times. The short last block of a source comes last in each pass, and its last slot may end within a block.

Everything follows from seeds and the rows' order (source, id, hash of the text), so reruns and retried tasks agree. Nothing per
document, slot or source is held on the driver. Sources are found, ranked and drawn as rows: a shard's draw goes down a tree
whose nodes hold at most ``FAN_OUT`` children.

Defined cases: a null text has no words, and documents without words are taken 0 times. Null is a source of its own, the last
one; a source without words has target 0 but takes part in the order of weights. Rows of one id are documents of their own; of
rows that agree in source, id and text the first in line may be taken more often. A very long text is cut in pieces and lies in many blocks.
An empty table gives no rows. Only doc_id, text and source are read; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from crawlgrain.llm.common import Scratch, map_arrow, mix64, prepare, read_table, text_bytes, text_slices

BLOCK_WORDS = 512
SHARD_SLOTS = 2048
#: Weights of the sources in order, repeating, and how often a source may be taken.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 11
#: Children of a node in the tree of sources: one draw looks at this many numbers.
FAN_OUT = 1024
_PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_WORD = r"[^\x20\x09-\x0D]"


# -- rows in a total order -----------------------------------------------------------------------
def _running(df: DataFrame, order: list[str | Column], totals: list[str], work: Scratch, name: str) -> DataFrame:
    """``df`` with ``before_<t>``: the sum of ``t`` over all rows earlier in ``order``. Ranges of the order are summed in their
    tasks; what goes through one task is one row a range."""
    made = [f"{x}_{t}" for t in totals for x in ("local", "sum")]
    schema = T.StructType([*df.schema, T.StructField("part", T.IntegerType()), *(T.StructField(m, T.LongType()) for m in made)])

    def work_on(batches):
        done, part = dict.fromkeys(totals, 0), TaskContext.get().partitionId()
        for batch in batches:
            new = []
            for t in totals:
                own = batch.column(batch.schema.get_field_index(t)).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(own)
                new += [pa.array(done[t] + ends - own, pa.int64()), pa.array(own)]
                done[t] += int(ends[-1]) if len(ends) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), *new], names=schema.names)

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _add_up(work.write(map_arrow(ranged, work_on, schema), name), totals, work, name)


def _add_up(local: DataFrame, totals: list[str], work: Scratch, name: str) -> DataFrame:
    """Adds to ``local_<t>``, sums within a ``part``, those of all parts before."""
    sums = local.groupBy("part").agg(*[F.sum(f"sum_{t}").alias(f"sum_{t}") for t in totals])
    earlier = "OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # One row a part: as many rows as the shuffle has partitions.
    starts = work.write(sums.selectExpr("part", *[f"coalesce(sum(sum_{t}) {earlier}, 0) AS start_{t}" for t in totals]), f"{name}-starts")
    kept = [c for c in local.columns if c != "part" and not c.startswith(("local_", "sum_"))]
    return local.join(starts, "part").select(*kept, *[(F.col(f"local_{t}") + F.col(f"start_{t}")).alias(f"before_{t}") for t in totals])


# -- documents -> blocks -------------------------------------------------------------------------
def _word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about a megabyte."""
    start = 0
    while start < len(raw):
        found = _BLANK.search(raw, start + _PIECE)
        stop = found.start() if found else len(raw)
        yield raw[start:stop].split()
        start = stop


def line_up(docs: DataFrame, work: Scratch) -> DataFrame:
    """doc_id, source, text, size (words) and before_size (words of all earlier documents) of documents with words, in the
    order of source, id and text hash. ``before_size`` tells the rows apart."""
    schema = T.StructType([docs.schema[c] for c in ("doc_id", "source", "text")])
    schema = T.StructType([*schema, *T.StructType.fromDDL("size long, part int, local_size long, sum_size long")])

    def count(batches):
        done, part = 0, TaskContext.get().partitionId()
        for batch in text_slices(batches):
            sizes = np.array([sum(map(len, _word_pieces(raw))) for raw in text_bytes(batch.column("text"))], dtype=np.int64)
            ends = done + np.cumsum(sizes)
            done = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "source", "text")), pa.array(sizes),
                 pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes), pa.array(sizes)], names=schema.names)

    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ranged = docs.where(F.col("text").rlike(_WORD)).select("doc_id", "source", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return _add_up(work.write(map_arrow(ranged, count, schema), "lined-up"), ["size"], work, "lined-up")


def pack(lined: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The pieces of documents that make up the blocks: src, block, at (place of the piece's first word in the block), words,
    doc_id, before_size (the document), first (the first word's place in the document) and text."""
    known = lined.join(sources.select("source", "src", "base"), lined["source"].eqNullSafe(sources["source"]))
    wanted = known.select("src", (F.col("before_size") - F.col("base")).alias("start"), "doc_id", "before_size", "text")
    schema = T.StructType.fromDDL("src long, block long, at int, words int")
    schema = T.StructType([*schema, wanted.schema["doc_id"], *T.StructType.fromDDL("before_size long, first long, text string")])

    def cut(batches):
        for batch in text_slices(batches):
            rows, texts = [], []
            columns = (batch.column(k).to_pylist() for k in (0, 1))
            for row, (src, start, raw) in enumerate(zip(*columns, text_bytes(batch.column("text")), strict=True)):
                first = 0
                for words in _word_pieces(raw):
                    done = 0
                    while done < len(words):
                        block, at = divmod(start + first, block_words)
                        n = min(block_words - at, len(words) - done)
                        rows.append((src, block, at, n, row, first))
                        texts.append(b" ".join(words[done : done + n]))
                        done, first = done + n, first + n
            src, block, at, n, row, first = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(src), pa.array(block), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
                 batch.column("doc_id").take(pa.array(row)), batch.column("before_size").take(pa.array(row)), pa.array(first),
                 pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return map_arrow(wanted, cut, schema)


# -- targets -------------------------------------------------------------------------------------
def rank_sources(docs: DataFrame, lined: DataFrame, work: Scratch, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, src (its place by code point, null last), weight, size and base (``before_size`` of its first document)."""
    sums = lined.groupBy("source").agg(F.sum("size").alias("size"), F.min("before_size").alias("base"))
    every = docs.select(F.col("source").alias("name")).distinct()
    found = every.join(sums, every["name"].eqNullSafe(sums["source"]), "left").select(
        F.col("name").alias("source"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("base", F.lit(0)).alias("base"),
        F.lit(1).alias("one"))
    ranked = _running(found, [F.col("source").asc_nulls_last()], ["one"], work, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int"))
    return work.write(ranked.select("source", F.col("before_one").alias("src"), weight.alias("weight"), "size", "base"), "ranked")


def _big(name: str) -> Column:
    return F.col(name).cast("decimal(16,0)")


def plan(sources: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST) -> DataFrame:
    """``sources`` with target, blocks (of one pass), quota (block slots that reach the target) and last (words of the last
    slot, null if whole).

    Shares go by weight; a source whose share is above ``most`` times its size stops there and the rest is shared anew, until
    none is above. Each round is one sum over the sources, of which two numbers come back."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    stopped, rest, weight = -1, total, 0
    while True:
        above = F.lit(False) if stopped < 0 else _big("weight") * F.lit(rest).cast("decimal(19,0)") > (
            F.lit(most).cast("decimal(3,0)") * _big("size") * F.lit(weight).cast("decimal(16,0)"))
        n, used, left = sources.agg(F.count_if(above), F.sum(F.when(above, most * F.col("size")).otherwise(0)),
                                    F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == stopped:
            break
        stopped, rest, weight = n, total - (used or 0), left or 0
    share = _big("weight") * F.lit(rest).cast("decimal(19,0)")
    # A literal below 2^31 is an int, as the weight is: their product would not hold the words of some gigabytes.
    target = F.when(above, (most * F.col("size")).cast("double")).otherwise(
        (F.col("weight").cast("long") * F.lit(rest).cast("long")).cast("double") / F.lit(float(weight or 1)))
    nearest = F.call_function("div", 2 * share + F.lit(weight).cast("decimal(16,0)"), F.lit(2 * weight or 1).cast("decimal(17,0)"))
    words = F.least(F.when(above, most * F.col("size")).otherwise(nearest), most * F.col("size"))
    found = sources.withColumns({"target": target, "take": words, "blocks": F.ceil(F.col("size") / block_words)})
    passes, over = F.expr("IF(size = 0, 0, take div size)"), F.expr("IF(size = 0, 0, take % size)")
    found = found.withColumns({"passes": passes, "over": over, "open": F.ceil(over / block_words)})
    return found.select(
        *sources.columns, "target", "blocks", (F.col("passes") * F.col("blocks") + F.col("open")).alias("quota"),
        F.when(F.col("over") > 0, F.col("over") - (F.col("open") - 1) * block_words).cast("int").alias("last"))


# -- pseudorandom permutations -------------------------------------------------------------------
def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of ``i`` in the permutation of ``0 .. n - 1`` that ``key`` names: a Feistel network over the next power of four,
    walked on until it falls below ``n``."""
    half = np.ones(len(n), dtype=np.uint64)
    for bits in range(1, 32):
        half[n > 1 << 2 * bits] = bits + 1
    x, key, mask = i.astype(np.uint64), key.astype(np.uint64), (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(1, 7):
            step = np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            left, right = right, left ^ (mix64(key[todo] + step + right) & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


@F.pandas_udf(T.LongType())
def _place(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(*(c.to_numpy(dtype=np.int64) for c in (i, n, key))))


def place(i: Column, n: Column, seed: int, use: str, *of: Column) -> Column:
    return _place(i.cast("long"), n.cast("long"), F.xxhash64(F.lit(seed), F.lit(use), *of))


# -- draws ---------------------------------------------------------------------------------------
def _multinomial(seed: int, level: int, root: tuple[list[int], list[int]] | None):
    """Rows of shard, node, n and, unless a ``root`` is given for all, the node's children and their quotas."""
    def work(batches):
        for batch in batches:
            shard, node, n, *met = (c.to_pylist() for c in batch.columns)
            child, quota = met or ([c] * len(n) for c in root)
            out = [[], [], []]
            for s, k, count, children, weights in zip(shard, node, n, child, quota, strict=True):
                weights = np.array(weights, dtype=float)
                drawn = np.random.default_rng([seed, level, s, k]).multinomial(count, weights / weights.sum())
                for at in np.flatnonzero(drawn):
                    for column, value in zip(out, (s, children[at], int(drawn[at])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["shard", "node", "n"])

    return work


def draw(planned: DataFrame, slots: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED, fan_out: int = FAN_OUT) -> DataFrame:
    """shard, src, n: a multinomial draw per shard with the quotas as weights."""
    spark = planned.sparkSession
    last = planned.agg(F.max("src")).first()[0] or 0
    levels = 1
    while fan_out**levels <= last:
        levels += 1
    rows = spark.range(-(-slots // shard_slots)).select(
        F.col("id").alias("shard"), F.lit(0).cast("long").alias("node"),
        F.least(F.lit(shard_slots), F.lit(slots) - F.col("id") * shard_slots).cast("long").alias("n"))
    for level in reversed(range(levels)):
        child = F.call_function("div", F.col("src"), F.lit(fan_out**level))
        sums = planned.where("quota > 0").groupBy(child.alias("child")).agg(F.sum("quota").alias("quota"))
        children = F.sort_array(F.collect_list(F.struct("child", "quota")))
        nodes = sums.groupBy(F.call_function("div", F.col("child"), F.lit(fan_out)).alias("node")).agg(children.alias("c"))
        nodes = nodes.select("node", F.col("c.child").alias("child"), F.col("c.quota").alias("quota"))
        # The root has at most ``fan_out`` children and travels with the task; further down shards meet their nodes by key.
        root = None
        if level == levels - 1:
            first = nodes.first()
            root = (first.child, first.quota) if first else ([], [])
        met = rows if root else rows.join(nodes, "node").select("shard", "node", "n", "child", "quota")
        rows = map_arrow(met, _multinomial(seed, level, root), "shard long, node long, n long")
    return rows.withColumnRenamed("node", "src")


def slot_table(planned: DataFrame, work: Scratch, shard_slots: int = SHARD_SLOTS, seed: int = SEED, fan_out: int = FAN_OUT,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """shard, place (in the shard), src, block and words (how many of the block's words are taken) of every slot."""
    slots = planned.agg(F.sum("quota")).first()[0] or 0
    drawn = _running(draw(planned, slots, shard_slots, seed, fan_out), ["src", "shard"], ["n"], work, "drawn")
    drawn = work.write(drawn, "draws")
    # Slots beyond a source's quota, and those it lacks, are numbered through all sources.
    got = drawn.groupBy("src").agg(F.sum("n").alias("drawn"), F.min("before_n").alias("first_n"))
    tally = planned.select("src", "quota").join(got, "src", "left").fillna({"drawn": 0, "first_n": 0})
    tally = tally.withColumns({"excess": F.expr("greatest(0L, drawn - quota)"), "lack": F.expr("greatest(0L, quota - drawn)")})
    tally = work.write(_running(tally, ["src"], ["excess", "lack"], work, "tally"), "tallied")

    in_shard = "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    each = drawn.selectExpr("*", f"{in_shard} AS ahead").join(tally.drop("lack", "before_lack"), "src").selectExpr(
        "src", "shard", "ahead", "before_n - first_n AS start", "drawn", "quota", "before_excess", "explode(sequence(0L, n - 1)) AS k")
    size = F.least(F.lit(shard_slots), F.lit(slots) - F.col("shard") * shard_slots)
    numbered = work.write(each.select(
        "src", "shard", "quota", "before_excess", place(F.col("ahead") + F.col("k"), size, seed, "place", F.col("shard")).alias("place"),
        place(F.col("start") + F.col("k"), F.col("drawn"), seed, "slot", F.col("src")).alias("x")), "numbered")
    lacking = tally.where("lack > 0").selectExpr("src", "drawn", "before_lack", "explode(sequence(0L, lack - 1)) AS k").selectExpr(
        "src", "drawn + k AS x", "before_lack + k AS handed")
    handed = numbered.where("x >= quota").selectExpr("shard", "place", "before_excess + x - quota AS handed").join(lacking, "handed")
    settled = numbered.where("x < quota").select("shard", "place", "src", "x").unionByName(handed.select("shard", "place", "src", "x"))

    known = settled.join(planned.select("src", "blocks", "quota", "last"), "src").selectExpr(
        "*", "x div blocks AS pass", "x % blocks AS i")
    block = place(F.least(F.col("i"), F.greatest(F.col("blocks") - 2, F.lit(0))), F.greatest(F.col("blocks") - 1, F.lit(1)),
                  seed, "block", F.col("src"), F.col("pass"))
    words = F.when(F.col("x") == F.col("quota") - 1, F.col("last"))
    return known.select("shard", "place", "src", F.when(F.col("i") == F.col("blocks") - 1, F.col("i")).otherwise(block).alias("block"),
                        F.coalesce(words, F.lit(block_words)).alias("words"))


# -- the mix -------------------------------------------------------------------------------------
def join_blocks(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """shard, place, at, src, doc_id, before_size, first, words and text: what the mix holds, in order of shard, place and at."""
    # Slots grow with the input, but their files are packed so well that they would be broadcast over some gigabytes.
    met = slots.withColumnRenamed("words", "wanted").hint("merge").join(pieces, ["src", "block"]).where("at < wanted")
    return met.select("shard", "place", "at", "src", "doc_id", "before_size", "first", F.least("words", F.col("wanted") - F.col("at")).alias("words"),
                      "text")


class Mix:
    """All steps over ``docs`` (doc_id, text, source). The tables of a run lie in the shared folder."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED,
                 weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fan_out: int = FAN_OUT):
        prepare(docs.sparkSession)
        self.docs, work = docs, Scratch(docs.sparkSession, "mix")
        self.lined = line_up(docs, work)
        self.sources = work.write(plan(rank_sources(docs, self.lined, work, weights), block_words, most), "planned")
        self.slots = work.write(slot_table(self.sources, work, shard_slots, seed, fan_out, block_words), "slots")
        self.pieces = pack(self.lined, self.sources, block_words)

    def rows(self) -> DataFrame:
        """The mix itself, piece by piece."""
        return join_blocks(self.slots, self.pieces)

    def write(self, path: str) -> None:
        """The mix as Parquet folders by shard, in order within each; a piece cut short by its slot is cut in its text."""
        cut = F.expr("array_join(slice(split(text, ' '), 1, words), ' ')")
        self.rows().withColumn("text", cut).repartition("shard").sortWithinPartitions("shard", "place", "at").write.parquet(path)

    def report(self) -> DataFrame:
        """doc_id, size, source_size, target and taken of every document."""
        taken = self.rows().groupBy("before_size").agg(F.sum("words").alias("taken"))
        with_words = self.lined.select("doc_id", "source", "size", "before_size").join(taken, "before_size", "left").select(
            "doc_id", "source", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
        without = self.docs.where(~F.coalesce(F.col("text").rlike(_WORD), F.lit(False))).select(
            "doc_id", "source", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("taken"))
        known = self.sources.select(F.col("source").alias("name"), F.col("size").alias("source_size"), "target")
        every = with_words.unionByName(without)
        return every.join(known, every["source"].eqNullSafe(known["name"])).select("doc_id", "size", "source_size", "target", "taken")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, its source's words and target, and how many of its words the mix takes."""
    return Mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).report()
