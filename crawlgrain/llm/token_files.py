"""Token-id files: a context-mixing range coder over blocks of ids, many blocks at a time.

A block of ``BLOCK`` ids is coded on its own: its models start empty, and its checksum is that of its ids. At each id an
order-2 and an order-1 table name the id last seen in that context. How often such a name is right, given how well it has
done so far, is learned in the block; these two chances and the file's id frequencies (order 0) are mixed to one
distribution over all ids, which drives a 64-bit carry-less range coder. All blocks of a file advance in step, one numpy
lane each, in the coder and in the decoder alike.

File: ``MAGIC``, sizes, then a compressed head (document ids and lengths, frequencies, block lengths and checksums) with
its own checksum, then the blocks' words. Files hold consecutive documents in ascending id order; their order is that of
their (partition, number), and ``manifest`` adds up where each starts.

Defined cases: a null text counts as empty, and like every document gets the end id. Null ids come first. Rows of one id
are ordered by their text. Texts are encoded whole. No documents: no files. Other columns are not read. An attempt that is
lost leaves a file that no manifest names, so it is never read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain.llm.bpe import byte_symbols
from crawlgrain.llm.common import Scratch, map_arrow, read_table, text_slices

MAGIC = b"TIDS2\n"
BLOCK = 4096
#: Ids of one file at most, plus those of its last document.
FILE_IDS = 8_000_000
END_ID = 0
#: Blocks coded in step.
LANES = 2048
_ONE_BITS, _TWO_BITS = 11, 12
_CONFIDENCES = 8
_TOTAL = 1 << 16
_WORD = np.uint64(0xFFFFFFFF)
_1, _24, _32 = np.uint64(1), np.uint64(24), np.uint64(32)
_LAST = np.uint64((1 << 24) - 1)
#: Ids below this are counted and numbered by a table, others by sorting.
_COUNTED = 1 << 22
#: Pieces, and their ids, that a task remembers; a full table is emptied, which costs time but no result.
WORDS_KEPT, IDS_KEPT = 700_000, 6_000_000
#: Pieces that a worker remembers between tasks.
WORDS_LEFT = 200_000


# -- texts to ids --------------------------------------------------------------------------------
_ODD_ASCII = [*map(chr, [9, 0xB, 0xC, 0xD, *range(0x1C, 0x20)])]
_ODD_WIDE = [*map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Signs whose runs the byte-level pattern surely takes apart: no apostrophe (contractions), no < (special tokens), line ends
# one at a time, and letters that every version of Unicode counts as such.
_LETTERS, _DIGITS, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9", "!-&(-/:;=-@\\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}{_DIGITS}{_MARKS}]+(?:\n[{_LETTERS}{_DIGITS}{_MARKS}]+)*")
_PARTS = re.compile(f" ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[{_MARKS}]+|\n")
#: Parts given to the library in one text: it takes longer for each with one or with very many.
_AT_ONCE = 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Numbers(dict):
    """Gives each key that it is asked for a number, and lists the new ones."""

    def __init__(self, known: Iterable[tuple[str, int]] = (), count: int = 0):
        super().__init__(known)
        self.count, self.new = count, []

    def __missing__(self, key: str) -> int:
        self[key] = number = self.count
        self.count = number + 1
        self.new.append(key)
        return number


def _longer(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a copy with room for ``n`` and as many again."""
    return a if n <= len(a) else np.concatenate((a, np.zeros(2 * n - len(a), dtype=a.dtype)))


class Encoder:
    """The tokenizers library over the pieces of a text, each distinct piece once.

    The byte-level pattern never looks across a space between two visible characters: what follows takes the space along.
    So the ids of a text are those of its pieces cut before such spaces. A plain piece is cut on, as the pattern would, and
    the library merges its parts, given as words in its signs for bytes; other pieces it cuts itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for own in (self.tokenizer, self.merger):
            own.no_truncation()
            own.no_padding()
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.merger.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        self.bytes_of[list(vocab.values())] = [len(token) for token in vocab]
        self.signs = np.array([ord(c) for c in byte_symbols()], dtype="<u2")
        self.signs[0] = 32  # parts do not hold it; it stands between them
        self.forget()

    def forget(self, kept: int = 0) -> None:
        """Keep only the ``kept`` pieces met first, which are mostly the frequent ones."""
        if not kept:
            # A piece that starts a text is known by a space and itself, another, which has a space before it, by itself.
            self.known = _Numbers()
            # Ids of the pieces, and by the number of a piece where its ids start and how many they are.
            self.store, self.used = np.zeros(1 << 16, dtype="<u4"), 0
            self.start, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        elif self.known.count > kept:
            self.known = _Numbers(((p, k) for p, k in self.known.items() if k < kept), kept)
            self.start, self.length = self.start[:kept].copy(), self.length[:kept].copy()
            self.used = int((self.start + self.length).max())
            self.store = self.store[: self.used].copy()

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Parts between the spaces at which the text may be cut."""
        holds = text.__contains__
        if (text[:1] == " " or text[-1:] == " " or holds("  ") or holds(" \n") or holds("\n ") or any(map(holds, _ODD_ASCII))
                or not text.isascii() and any(map(holds, _ODD_WIDE))):
            return _CUT.split(text)
        return text.split(" ")

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has: given as ready cut, all are one encoding that says which piece an id is of."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(found.word_ids), np.arange(len(pieces)), side="right")
        return np.array(found.ids, dtype="<u4"), np.diff(ends, prepend=0)

    def _merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the pattern does not cut, and how many each has: tokens are told apart by their bytes."""
        raw = np.frombuffer("\0".join([*parts, ""]).encode(), dtype=np.uint8)
        shown = self.signs[raw].tobytes().decode("utf-16-le")
        gaps = np.flatnonzero(raw == 0)
        cuts = [*gaps[_AT_ONCE - 1 : -1 : _AT_ONCE].tolist(), len(shown) - 1]
        found = self.merger.encode_batch_fast([shown[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], add_special_tokens=False)
        ids = np.array(list(chain.from_iterable([f.ids for f in found])), dtype="<u4")
        stands, wanted = np.cumsum(self.bytes_of[ids]), gaps - np.arange(len(gaps))
        ends = np.searchsorted(stands, wanted)
        if ends[-1] != len(ids) - 1 or (stands[ends] != wanted).any():
            return self._ids(parts)  # a vocabulary that does not know every byte
        return ids, np.diff(ends + 1, prepend=0)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Put ids away; where those of each length start."""
        begin = self.used
        self.used += len(ids)
        self.store = _longer(self.store, self.used)
        self.store[begin : self.used] = ids
        return begin + np.cumsum(lengths) - lengths

    def _gather(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ids that stand at the given places, one after the other."""
        ends = np.cumsum(length)
        at = np.repeat(start - ends + length, length)
        at += np.arange(len(at))
        return self.store.take(at)

    def _learn(self, keys: list[str], first: int) -> None:
        """Find the ids of new pieces, which are numbered from ``first`` on."""
        self.start, self.length = _longer(self.start, self.known.count), _longer(self.length, self.known.count)
        plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, keys)), dtype=bool, count=len(keys))
        if plain.any():
            self._learn_plain(list(compress(keys, plain)), first + np.flatnonzero(plain), first)
        if not plain.all():
            odd = first + np.flatnonzero(~plain)
            ids, length = self._ids([key[1:] if key[0] == " " else " " + key for key in compress(keys, ~plain)])
            self.start[odd], self.length[odd] = self._add(ids, length), length

    def _learn_plain(self, keys: list[str], numbers: np.ndarray, first: int) -> None:
        cut, parts = _PARTS.findall(" " + " ".join(keys)), _Numbers()
        of = np.fromiter(map(parts.__getitem__, cut), dtype=np.int64, count=len(cut))
        # Each key's parts begin where its text does.
        size = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        long = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys)) + 1
        begin = np.searchsorted(np.cumsum(size) - size, np.cumsum(long) - long)
        # A part may be a piece of an earlier batch.
        number_of = self.known.get
        old = np.array([number_of(part[1:], first) if part[0] == " " else first for part in parts.new])
        fresh = old >= first
        old[fresh] = 0
        start, length = self.start[old], self.length[old]
        if fresh.any():
            ids, length[fresh] = self._merged(list(compress(parts.new, fresh)))
            start[fresh] = self._add(ids, length[fresh])
        start, length = start[of], length[of]
        count = np.diff(begin, append=len(cut))
        single, total = count == 1, np.add.reduceat(length, begin)
        self.start[numbers], self.length[numbers] = start[begin], total
        several = np.repeat(~single, count)
        self.start[numbers[~single]] = self._add(self._gather(start[several], length[several]), total[~single])

    def encode(self, texts: list[str | None], end: int = END_ID) -> list[bytes]:
        """Ids of each text with the end id, as little-endian 32-bit integers."""
        if self.known.count > WORDS_KEPT or self.used > IDS_KEPT:
            self.forget()
        known, first = self.known, self.known.count
        numbers, counts = array("q"), []
        for text in texts:
            if text:
                cut = self.pieces(text)
                cut[0] = " " + cut[0]
                numbers.extend(map(known.__getitem__, cut))
                counts.append(len(cut))
            else:
                counts.append(0)
        new, known.new = known.new, []
        if new:
            self._learn(new, first)
        of = np.frombuffer(numbers, dtype=np.int64)
        lengths = self.length[of]
        raw = self._gather(self.start[of], lengths).tobytes()
        ends = (4 * np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)]).tolist()
        tail = struct.pack("<I", end)
        out = [raw[a:b] + tail for a, b in zip([0, *ends], ends, strict=False)]
        for key in new:
            if len(key) > 100:
                del known[key]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- the model -----------------------------------------------------------------------------------
class _Model:
    """Order-2 and order-1 tables of many lanes and the chances that their names are right, in two rows: order 2 and order 1.

    ``kinds`` is the number of symbols. It stands for a name where nothing was named yet, which is never right.
    """

    def __init__(self, lanes: int, kinds: int):
        lane = np.arange(lanes, dtype=np.int64)
        # An entry: the id named, times the number of confidences, plus the confidence; 0: nothing named yet.
        self.entries = np.full((lanes << _TWO_BITS) + (lanes << _ONE_BITS), kinds * _CONFIDENCES, dtype=np.int32)
        self.base = np.stack((lane << _TWO_BITS, (lane << _ONE_BITS) + (lanes << _TWO_BITS)))
        # Chances in 1 / 65536, by confidence and whether both orders name the same id. Without confidence there is none, and
        # order 1 has none where it names what order 2 does.
        start = np.minimum(np.arange(_CONFIDENCES) * 9000, 60000)
        agreed = np.where(start > 0, np.minimum(start + 6000, 62000), 0)
        self.chances = np.concatenate((np.tile(np.concatenate((start, agreed)), lanes), np.tile(np.concatenate((start, 0 * start)), lanes))).astype(np.int32)
        self.rows = np.stack((lane, lane + lanes)) * (2 * _CONFIDENCES)
        self.last = np.zeros(lanes, dtype=np.uint16)
        self.before = np.zeros(lanes, dtype=np.uint16)
        self.spread = np.zeros((2, lanes), dtype=np.uint16)
        self.at, self.ctx = np.zeros((2, lanes), dtype=np.int64), np.zeros((2, lanes), dtype=np.int64)
        self.entry, self.chance, self.share = (np.zeros((2, lanes), dtype=np.int32) for _ in range(3))
        # Numpy takes a row of constants faster than a Python number.
        self.factors = np.array([[60493], [40503]], dtype=np.uint16) + np.zeros((2, lanes), dtype=np.uint16)
        self.shifts = np.array([[4], [5]], dtype=np.uint16) + np.zeros((2, lanes), dtype=np.uint16)
        self.n1, self.n2, self.n3, self.n4, self.n6, self.n7, self.n8, self.n16, self.n254, self.n255, self.full = (
            np.full((2, lanes), k, dtype=np.int32) for k in (1, 2, 3, 4, 6, 7, 8, 16, 254, 255, 65535))

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids named by order 2 and 1, their shares of 256 times 65536, and what is left of 256, at least 1, for order 0."""
        spread = self.spread  # the hashes are bits of the low 16
        np.multiply(self.last, self.factors[1], out=spread[1])
        np.multiply(self.before, self.factors[0], out=spread[0])
        spread[0] += spread[1]
        np.add(self.base, spread >> self.shifts, out=self.at)
        entry = self.entries.take(self.at, out=self.entry, mode="clip")
        self.names = names = entry >> self.n3
        self.sure = entry & self.n7
        self.other = names[0] != names[1]
        ctx = self.sure + self.n8
        ctx -= self.other * self.n8[0]
        np.add(self.rows, ctx, out=self.ctx)
        chance = self.chances.take(self.ctx, out=self.chance, mode="clip")
        share = self.share
        np.right_shift(chance[0], self.n8[0], out=share[0])
        np.minimum(share[0], self.n254[0], out=share[0])
        rest = self.n255[0] - share[0]
        np.multiply(rest, chance[1], out=share[1])
        share[1] >>= self.n16[0]
        rest -= share[1]
        rest += self.n1[0]
        share <<= self.n16
        return names, share, rest

    def update(self, x: np.ndarray, narrow: np.ndarray, hits: np.ndarray) -> None:
        """``x`` came, ``narrow`` in 16 bits, which order 2 and 1 did or did not name."""
        fresh = x << self.n3[0]
        fresh += self.n1[0]
        # Named rightly: surer by one, 7 at most. Else a name that is sure by 3 stays, less sure by 2, and others are replaced.
        made = np.minimum(self.sure, self.n6)
        made *= hits
        made += fresh
        stays = self.entry - self.n2
        stays -= made
        stays *= (self.sure >= self.n3) > hits
        made += stays
        self.entries[self.at] = made
        # Order 1 is asked where order 2 named another id and was wrong.
        np.logical_and(hits[1], self.other, out=hits[1])
        change = hits * self.full
        change -= self.chance
        change >>= self.n4
        change[1] *= ~hits[0]
        change += self.chance
        self.chances[self.ctx] = change
        self.before, self.last = self.last, narrow


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a file and their order-0 frequencies, which sum to ``_TOTAL``."""
    if len(ids) and int(ids.max()) < _COUNTED:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > _TOTAL:
        raise ValueError("more distinct ids in a file than the coder can tell apart")
    freq = 1 + counts * (_TOTAL - len(symbols)) // counts.sum()
    freq[counts.argmax()] += _TOTAL - freq.sum()
    return symbols, freq


def _numbers(ids: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The place of each id among the symbols."""
    if int(symbols[-1]) >= _COUNTED:
        return np.searchsorted(symbols, ids).astype(np.uint16)
    place = np.zeros(int(symbols[-1]) + 1, dtype=np.uint16)
    place[symbols] = np.arange(len(symbols))
    return place[ids]


def _shape(n: int) -> tuple[int, np.ndarray]:
    blocks = -(-n // BLOCK)
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - BLOCK * (blocks - 1)
    return blocks, sizes


def _order0(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums below each symbol and the frequencies, with an end for the name that stands for none."""
    return np.concatenate(([0], np.cumsum(freq))).astype(np.int32), np.append(freq, 0).astype(np.int32)


def encode_blocks(ids: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """Words of each block. ``ids`` are numbers of the file's symbols."""
    blocks, sizes = _shape(len(ids))
    padded = np.zeros(blocks * BLOCK, dtype=np.uint16)
    padded[: len(ids)] = ids
    table = padded.reshape(blocks, BLOCK)
    below, freq = _order0(freq)
    out: list[np.ndarray] = []
    for first in range(0, blocks, LANES):
        own = np.ascontiguousarray(table[first : first + LANES].T)
        size = sizes[first : first + LANES]
        lanes = len(size)
        model = _Model(lanes, len(freq) - 1)
        low = np.zeros(lanes, dtype=np.uint64)
        span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        room = 2 * BLOCK + 4
        words = np.zeros(lanes * room, dtype=np.uint32)
        begin = np.arange(lanes) * room
        free = begin.copy()
        for step in range(int(size.max())):
            narrow = own[step]
            x = narrow.astype(np.int32)
            names, share, rest = model.predict()
            low, span, hits = _narrow(low, span, x, narrow, names, share, rest, below, freq)
            low, span, done, top = _settle(low, span)
            if len(done):
                if size[-1] <= step and done[-1] == lanes - 1:  # only the last block is shorter: what follows its end is not kept
                    done, top = done[:-1], top[:-1]
                at = free[done]
                words[at] = top
                at += 1
                free[done] = at
            model.update(x, narrow, hits)
            if size[-1] == step + 1 and step + 1 < size.max():
                words[free[-1] : free[-1] + 2] = int(low[-1]) >> 32, int(low[-1]) & 0xFFFFFFFF
                free[-1] += 2
                closed = True
            elif step == 0:
                closed = False
        for lane in range(lanes):
            if not (closed and lane == lanes - 1):
                words[free[lane] : free[lane] + 2] = int(low[lane]) >> 32, int(low[lane]) & 0xFFFFFFFF
                free[lane] += 2
        out += [words[a:b].copy() for a, b in zip(begin.tolist(), free.tolist(), strict=True)]
    return out


def _narrow(
    low: np.ndarray, span: np.ndarray, x: np.ndarray, at: np.ndarray, names: np.ndarray, share: np.ndarray, rest: np.ndarray, below: np.ndarray, freq: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each lane's span narrowed to that of its symbol ``x``, and which names were right."""
    hits = names == x
    start = below.take(at, mode="clip")
    start *= rest
    raised = (names < x) * share
    start += raised[0]
    start += raised[1]
    width = freq.take(at, mode="clip")
    width *= rest
    np.multiply(hits, share, out=raised)
    width += raised[0]
    width += raised[1]
    unit = span >> _24
    return low + unit * start.view(np.uint32), unit * width.view(np.uint32), hits


def _settle(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes whose leading word is settled, or made so by giving up a little of the span, shift it out."""
    differ = low + span
    differ -= _1
    differ ^= low
    equal = differ <= _WORD
    done = np.flatnonzero(equal | (span <= _WORD))
    if not len(done):
        return low, span, done, done
    own, wide = low[done], span[done]
    cross = ~equal[done]
    if cross.any():
        wide[cross] = (~own[cross] & _WORD) + _1
    low[done] = own << _32
    # A full span of 2 ** 32 would overflow by one.
    span[done] = np.where(wide > _WORD, np.uint64(0xFFFFFFFFFFFFFFFF), wide << _32)
    return low, span, done, (own >> _32).astype(np.uint32)


def decode_blocks(words: list[np.ndarray], n: int, freq: np.ndarray) -> np.ndarray:
    """The ``n`` symbol numbers that ``encode_blocks`` was given."""
    blocks, sizes = _shape(n)
    symbol_at = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
    below, freq = _order0(freq)
    out = np.zeros((blocks, BLOCK), dtype=np.uint16)
    for first in range(0, blocks, LANES):
        own = words[first : first + LANES]
        lanes = len(own)
        flat = np.concatenate([np.concatenate((w, np.zeros(2 * BLOCK + 4 - len(w) if k == lanes - 1 else 4, np.uint32))) for k, w in enumerate(own)])
        reads = np.cumsum([0, *[len(w) + 4 for w in own[:-1]]])
        code = (flat[reads].astype(np.uint64) << _32) | flat[reads + 1]
        reads = reads + 2
        model = _Model(lanes, len(freq) - 1)
        low = np.zeros(lanes, dtype=np.uint64)
        span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        table, zeros = np.zeros((BLOCK, lanes), dtype=np.uint16), np.zeros((2, lanes), dtype=np.int32)
        for step in range(int(sizes[first : first + LANES].max())):
            names, share, rest = model.predict()
            value = code - low
            value //= span >> _24
            value = np.minimum(value, _LAST).astype(np.int32)
            # The two names raise the distribution at their places: what is raised is taken out again.
            raised = below.take(names, mode="clip")
            raised *= rest
            raised[0] += (names[1] < names[0]) * share[1]
            raised[1] += (names[0] < names[1]) * share[0]
            np.subtract(value, raised, out=raised)
            np.maximum(raised, zeros, out=raised)
            np.minimum(raised, share, out=raised)
            value -= raised[0]
            value -= raised[1]
            narrow = symbol_at.take((value / rest).astype(np.int64), mode="clip")
            x = narrow.astype(np.int32)
            low, span, hits = _narrow(low, span, x, narrow, names, share, rest, below, freq)
            low, span, done, _ = _settle(low, span)
            if len(done):
                at = reads[done]
                code[done] = (code[done] << _32) | flat.take(at, mode="clip")
                at += 1
                reads[done] = at
            table[step] = narrow
            model.update(x, narrow, hits)
        out[first : first + LANES] = table.T
    return out.reshape(-1)[:n]


# -- files ---------------------------------------------------------------------------------------
def pack_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of one file."""
    every = np.frombuffer(b"".join(ids), dtype="<u4")
    symbols, freq = _frequencies(every)
    words = encode_blocks(_numbers(every, symbols), freq)
    checks = [zlib.crc32(every[k * BLOCK : (k + 1) * BLOCK].tobytes()) for k in range(len(words))]
    head = zlib.compress(b"".join([
        np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes(),
        np.array([i is None for i in doc_ids], dtype="u1").tobytes(),
        np.array([len(x) // 4 for x in ids], dtype="<i8").tobytes(),
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(),
        np.array([len(w) for w in words], dtype="<u4").tobytes(), np.array(checks, dtype="<u4").tobytes()]))
    sizes = struct.pack("<QQQQQ", len(doc_ids), len(every), len(symbols), len(words), len(head))
    return b"".join([MAGIC, sizes, struct.pack("<I", zlib.crc32(sizes + head)), head, *[w.astype("<u4").tobytes() for w in words]])


def unpack_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and the ids of each; raises ``ValueError`` if anything was damaged."""
    n = len(MAGIC)
    if data[:n] != MAGIC:
        raise ValueError("not a token-id file")
    sizes, (check,) = data[n : n + 40], struct.unpack("<I", data[n + 40 : n + 44])
    docs, total, symbols, blocks, length = struct.unpack("<QQQQQ", sizes)
    head = data[n + 44 : n + 44 + length]
    if zlib.crc32(sizes + head) != check:
        raise ValueError("damaged head of a token-id file")
    head = zlib.decompress(head)
    parts, at = [], 0
    for kind, count in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<u4", symbols), ("<u4", symbols), ("<u4", blocks), ("<u4", blocks)):
        step = np.dtype(kind).itemsize * count
        parts.append(np.frombuffer(head[at : at + step], dtype=kind))
        at += step
    doc_ids, missing, lengths, names, freq, words, checks = parts
    body = np.frombuffer(data[n + 44 + length :], dtype="<u4")
    numbers = decode_blocks(np.split(body, np.cumsum(words)[:-1]), total, freq.astype(np.int64))
    every = names[numbers]
    for k, want in enumerate(checks.tolist()):
        if zlib.crc32(every[k * BLOCK : (k + 1) * BLOCK].tobytes()) != want:
            raise ValueError(f"damaged block {k} of a token-id file")
    ends = np.cumsum(lengths)
    return ([None if m else int(i) for i, m in zip(doc_ids, missing, strict=True)],
            [every[a:b] for a, b in zip(ends - lengths, ends, strict=True)])


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    plain = re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(plain)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` and write token-id files to ``folder``, which all executors share.

    Returns the manifest: file, partition, number, docs and ids of each file that counts.
    """
    path = path or default_path()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        own, doc_ids, ids, held, number = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held, number
            name = f"ids-{own:06d}-{number:04d}-{uuid.uuid4().hex}.tids"
            with where.open_output_stream(f"{base}/{name}") as out:
                out.write(pack_file(doc_ids, ids))
            row = pa.RecordBatch.from_pydict({"file": [name], "partition": [own], "number": [number], "docs": [len(doc_ids)], "ids": [held]})
            doc_ids, ids, held, number = [], [], 0, number + 1
            return row

        for batch in text_slices(batches, 2 << 20):
            new = encoder(path).encode(batch.column("text").to_pylist(), end)
            for i, x in zip(batch.column("doc_id").to_pylist(), new, strict=True):
                doc_ids.append(i)
                ids.append(x)
                held += len(x) // 4
                if held >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()
        encoder(path).forget(WORDS_LEFT)

    return map_arrow(ordered, work, "file string, partition long, number long, docs long, ids long")


def read_token_files(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens and ids (as bytes) of each document in the files of a collected ``manifest``."""
    at, starts = 0, {}
    for row in sorted(manifest, key=lambda r: (r.partition, r.number)):
        starts[row.file] = at
        at += row.ids
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    shared = spark.sparkContext.broadcast(starts)  # one number a file
    files = spark.read.format("binaryFile").load([f"{folder}/{name}" for name in starts]).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                doc_ids, ids = unpack_file(data.as_py())
                lengths = np.array([len(x) for x in ids], dtype=np.int64)
                begin = shared.value[name.rpartition("/")[2]] + np.cumsum(lengths) - lengths
                step = 2000
                for k in range(0, len(ids), step):
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc_ids[k : k + step], pa.int64()), "start": pa.array(begin[k : k + step], pa.int64()),
                        "n_tokens": pa.array(lengths[k : k + step], pa.int64()),
                        "ids": pa.array([x.tobytes() for x in ids[k : k + step]], pa.binary())})

    return map_arrow(files, work, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-files").root
    # One row for each file reaches the driver.
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), folder).collect()
    found = read_token_files(spark, folder, manifest)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
