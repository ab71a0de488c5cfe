"""Byte-pair encoding and decoding with a pair occurrence index.

A task collects the distinct pre-tokens it has not met yet, lays their symbols out in one linked list and maps each
adjacent pair to all its positions. Active ranks are applied in ascending order: each takes the positions of its pair
from left to right, merges them and adds the pairs that arise beside them to the lists of their ranks. A whole batch is
merged in one such pass, and a very long pre-token costs no more per symbol than a short one.

Normalising and splitting follow the tokenizer file (NFC, one space for white space, lower case; contractions, runs of
letters, single digits, runs of other signs; a mark at the end of each pre-token). Special tokens are cut out of the raw
text first. Decoding joins the tokens of the ids by spaces, as a tokenizer file without a decoder asks for.

Defined cases: a null or blank text has no ids and decodes to an empty text. Texts are encoded whole. Repeated rows are
encoded alike. Other columns of the input are kept; existing ``ids``, ``n_tokens`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain.llm.common import kept_columns, map_arrow, read_table, text_slices

#: Entries of a task's tables of words and chunks; a full table is emptied, which costs time but no result.
WORD_ENTRIES, CHUNK_ENTRIES = 600_000, 500_000
#: Words that a worker keeps between tasks.
WORDS_KEPT = 50_000
_CACHED_LENGTH = 64

# White space as the tokenizer's patterns see it; Python's own also counts \x1c-\x1f.
_WIDE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE = "\t-\r " + _WIDE
_SEPARATORS = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile(f"[^{_SPACE}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    shown = {b: chr(b) for b in plain}
    return [shown[b] if b in shown else chr(next(extra)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"]["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        # Rank of a pair by its first and by its second symbol.
        self.ranks_from: dict[int, dict[int, int]] = defaultdict(dict)
        self.ranks_to: dict[int, dict[int, int]] = defaultdict(dict)
        for rank, (a, b, _) in reversed(list(enumerate(self.merges))):
            self.ranks_from[a][b] = self.ranks_to[b][a] = rank
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        shown = byte_symbols()
        self.inner = np.array([vocab[s] for s in shown])
        self.last = np.array([vocab[s + self.end] for s in shown])
        ranks = lambda right: np.array([[self.ranks_from[a].get(b, -1) for b in right.tolist()] for a in self.inner.tolist()])
        self.byte_ranks, self.byte_ranks_last = ranks(self.inner), ranks(self.last)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words: dict[str, tuple[bytes, str]] = {}
        self.chunk_ids: dict[str | int, bytes] = {}
        self.chunk_text: dict[str | int, str] = {}

    def trim_words(self) -> None:
        """Keep the words met first, which are mostly the frequent ones."""
        self.words = dict(islice(self.words.items(), WORDS_KEPT))

    def forget(self) -> None:
        """Make room: the worker's next task may be another operator's."""
        self.trim_words()
        self.chunk_ids, self.chunk_text = {}, {}

    # -- merging -----------------------------------------------------------------------------------
    def merge(self, words: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Ids and tokens of distinct pre-tokens, all merged in one pass over the pair occurrence index."""
        raws = {word: word.encode("utf-8", "surrogatepass") for word in words}
        if not raws:
            return {}
        signs = np.frombuffer(b"".join(raws.values()), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raws.values()), dtype=np.int64, count=len(raws)))
        n = len(signs)
        symbols = self.inner[signs]
        symbols[ends - 1] = self.last[signs[ends - 1]]
        # The index: rank -> positions of its pair, from left to right.
        pair_rank = self.byte_ranks[signs[:-1], signs[1:]]
        at_end = np.zeros(n, dtype=bool)
        at_end[ends - 1] = True
        pair_rank[at_end[1:]] = self.byte_ranks_last[signs[:-1], signs[1:]][at_end[1:]]
        pair_rank[at_end[:-1]] = -1
        where = np.flatnonzero(pair_rank >= 0)
        where = where[np.argsort(pair_rank[where])]  # each list is sorted when its turn comes
        active, first = np.unique(pair_rank[where], return_index=True)
        places = {r: where[i:j].tolist() for r, i, j in zip(active.tolist(), first, np.append(first, len(where))[1:], strict=True)}
        active = active.tolist()  # ascending, so a heap already
        ids, following, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        for end in ends.tolist():
            following[end - 1] = -1
            if end < n:
                before[end] = -1
        merges, push, pop, listed = self.merges, heapq.heappush, heapq.heappop, places.get
        while active:
            rank = pop(active)
            a, b, made = merges[rank]
            # Ranks of the pairs that the made symbol forms with what follows and with what comes before it.
            with_next, with_last = self.ranks_from[made].get, self.ranks_to[made].get
            for i in sorted(places.pop(rank)):
                j = following[i]
                if j < 0 or ids[i] != a or ids[j] != b:
                    continue  # a neighbour was merged meanwhile
                ids[i], ids[j] = made, -1
                following[i] = k = following[j]
                if k >= 0:
                    before[k] = i
                    found = with_next(ids[k])
                    if found is not None:
                        own = listed(found)
                        if own is not None:
                            own.append(i)
                        else:
                            places[found] = [i]
                            push(active, found)
                k = before[i]
                if k >= 0:
                    found = with_last(ids[k])
                    if found is not None:
                        own = listed(found)
                        if own is not None:
                            own.append(k)
                        else:
                            places[found] = [k]
                            push(active, found)
        final = np.array(ids, dtype="<i4")
        left = final >= 0
        packed, counts = final[left].tobytes(), np.diff(np.cumsum(left)[ends - 1], prepend=0)
        shown = [self.tokens[i] for i in final[left].tolist()]
        out, start = {}, 0
        for word, count in zip(raws, counts.tolist(), strict=True):
            stop = start + count
            out[word] = packed[4 * start : 4 * stop], " ".join(shown[start:stop])
            start = stop
        return out

    # -- texts -------------------------------------------------------------------------------------
    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # no special form at the end of a word
        return text.lower()

    def cut_up(self, text: str) -> list[str | int]:
        """White-space separated chunks of the normalised text; special tokens as their ids."""
        out: list[str | int] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                part = self.normalise(part)
                out += _CHUNK.findall(part) if _SEPARATORS.search(part) else part.split()
        return out

    def learn(self, chunks: Iterable[str | int]) -> dict[str | int, tuple[bytes, str]]:
        """Ids (as little-endian integers) and tokens of new chunks."""
        split = {c: self.pre_tokens(c) for c in chunks if type(c) is str}
        known = self.words
        found = self.merge({w for words in split.values() for w in words if w not in known})
        out: dict[str | int, tuple[bytes, str]] = {
            c: (np.array([c], dtype="<i4").tobytes(), self.decode([c])) for c in chunks if type(c) is int}
        for chunk, words in split.items():
            parts = [found[w] if w in found else known[w] for w in words]
            out[chunk] = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
        if len(self.words) + len(found) > WORD_ENTRIES:
            self.trim_words()
        self.words |= {w: ids for w, ids in found.items() if len(w) <= _CACHED_LENGTH}
        return out

    def pre_tokens(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]  # one run of letters, by far the most
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.split.findall(chunk)

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def encode_batch(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Ids (as little-endian integers) and decoded form of each text."""
        cut = [self.cut_up(t) if t else [] for t in texts]
        if len(self.chunk_ids) > CHUNK_ENTRIES:
            self.chunk_ids, self.chunk_text = {}, {}
        new = set().union(*cut).difference(self.chunk_ids)
        found = self.learn(new)
        self.chunk_ids |= {c: v[0] for c, v in found.items()}
        self.chunk_text |= {c: v[1] for c, v in found.items()}
        ids_of, text_of = self.chunk_ids.__getitem__, self.chunk_text.__getitem__
        out = [b"".join(map(ids_of, c)) for c in cut], [" ".join(map(text_of, c)) for c in cut]
        for c in [c for c in found if type(c) is str and len(c) > _CACHED_LENGTH]:
            del self.chunk_ids[c], self.chunk_text[c]
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) plus ``n_tokens``, ``ids`` and ``decoded`` of its ``text``."""
    path = path or default_path()
    made = ("n_tokens", "ids", "decoded")
    keep = [c for c in kept_columns(docs, made) if keep is None or c in keep]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in text_slices(batches, 2 << 20):
            joined, decoded = bpe.encode_batch(batch.column("text").to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in joined]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(joined), dtype="<i4")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(np.diff(ends).astype(np.int64)), ids,
                 pa.array(decoded, pa.string())],
                [*batch.schema.names[: len(keep)], *made])
        bpe.forget()

    fields = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    done = map_arrow(source, work, ", ".join([*fields, "n_tokens long", "ids array<int>", "decoded string"]))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *made)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(read_table(spark, sf_dir, "documents"), keep=["doc_id"]))
