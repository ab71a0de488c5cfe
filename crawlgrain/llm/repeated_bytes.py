"""Removal of repeated passages: bytes in a 50-byte string that also starts in a document with a smaller id.

1. Documents are packed into chunks of about a megabyte and written once. Equal texts keep the smallest id's copy.
2. Every 50-byte window has one anchor, the least hash among its 16-byte strings; equal windows have equal anchors. Anchor
   hashes are packed by chunk and hash bucket and counted; only those that occur in two documents matter from here on.
3. For each such anchor, the bytes of the windows it stands for (67 on average for 18 windows) go to the shard of its
   hash. A chunk sends equal pieces of different documents once, for the smallest id.
4. A shard builds a suffix array by Larsson-Sadakane refinement and common prefixes after Kasai, both in numpy. Runs of
   suffixes with 50 bytes in common are equal windows; those of a document above the run's smallest id are removed.
5. Anchors of very many chunks are split over several shards. These hand on their distinct windows in sorted order with the
   smallest id of each, and the sorted runs are merged by binary search.
6. The removed windows return to their chunks, which cut them out.

Buckets, shards and splits grow with the input, so a task's share does not. Shards go in blocks of up to ``BLOCK_SHARDS``: a chunk
and a block exchange one row each way, and a block's shards are worked on one after the other. Nothing is collected but sums.

Defined cases: a null text counts as empty. A document with a null id neither removes nor loses anything. Rows of one id
are one document as to what is smaller, and are each judged. Texts under 50 bytes stay whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain.llm.common import Scratch, give_back, map_arrow, mix64, read_table, text_bytes, text_slices

LENGTH, GRAM = 50, 16
_WINDOW = LENGTH - GRAM + 1
CHUNK_BYTES = 1 << 20
#: Bytes of input for each hash bucket and for each shard. Rows between chunks and buckets grow with the product of the two.
BUCKET_BYTES, SHARD_BYTES = 64 << 20, 1 << 20
#: Most shards of a block (their numbers within it are bytes), and the number of blocks from which they are as large.
BLOCK_SHARDS, BLOCKS = 32, 64
#: Chunks whose pieces of one anchor may meet in one shard; anchors found in more are split.
CHUNKS_A_SPLIT = 4096
_PARTS = 16
_PLACE = np.uint64((1 << 21) - 1)
_PIECE = 1 << 18
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# -- chunks --------------------------------------------------------------------------------------
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in text_slices(batches, CHUNK_BYTES):
        raws = [raw or b"" for raw in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int.from_bytes(os.urandom(8), "little") >> 1], pa.int64()),
             pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
             pa.array([np.cumsum([len(r) for r in raws])], pa.list_(pa.int64())),
             pa.array([[hashlib.sha256(r).hexdigest() for r in raws]], pa.list_(pa.string())),
             pa.array([squeeze.compress(b"".join(raws))], pa.binary())], ["chunk", "ids", "ends", "digests", "blob"])


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window start of each run of windows with one anchor. Windows never cross ``ends``."""
    found = []
    starts = np.concatenate(([0], ends[:-1]))
    for base in range(0, max(1, len(text) - LENGTH + 1), _PIECE):
        t = text[base : base + _PIECE + LENGTH - 1]
        n = len(t) - LENGTH + 1
        if n < 1:
            continue
        eight = as_strided(t, (len(t) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
        h = mix64(eight[:-8] * _K1 + eight[8:] * _K2)
        # The place makes the last of equal hashes the least.
        low = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        for step in (1, 2, 4, 8, 16):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: -(_WINDOW - 32)], low[_WINDOW - 32 :])
        at = (_PLACE - (low & _PLACE)).astype(np.int64)
        change = np.zeros(n + 1, dtype=np.int32)
        a, b = np.maximum(starts - base, 0), np.minimum(ends - LENGTH + 1 - base, n)
        use = a < b
        np.add.at(change, a[use], 1)
        np.add.at(change, b[use], -1)
        valid = np.cumsum(change[:-1]) > 0
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= new[1:] | ~valid[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        found.append((h[at[first]], first + base, last + base))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keys(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the hashes that are counted: the bucket and 32 more."""
    return h >> np.uint64(32 - bits)


def _count_anchors(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, first, _ = anchors(_unpack(row["blob"]), np.array(row["ends"], dtype=np.int64))
                doc = np.searchsorted(np.array(row["ends"]), first, side="right")
                key = _keys(h, bits)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, docs = np.unique(key[new], return_counts=True)
                bucket = (key >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = [slice(a, b) for a, b in zip(cuts, np.append(cuts, len(key))[1:], strict=True)]
                rest = key.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts], pa.int64()), pa.array([row["chunk"]] * len(cuts), pa.int64()),
                     pa.array([rest[p].tobytes() for p in parts], pa.binary()),
                     pa.array([np.packbits(docs[p] > 1).tobytes() for p in parts], pa.binary())], ["bucket", "chunk", "keys", "twice"])

    return work


def _repeated(split_at: int):
    """Of one bucket: each chunk's anchors that occur in two documents, and which of them in very many chunks."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, dtype=np.uint32) for k in rows["keys"]]
        twice = [np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(k)) for t, k in zip(rows["twice"], keys, strict=True)]
        every = np.concatenate(keys)
        known, which, chunks = np.unique(every, return_inverse=True, return_counts=True)
        documents = chunks + np.bincount(which, weights=np.concatenate(twice), minlength=len(known))
        again, many = documents > 1, chunks > split_at
        out, at = [], 0
        for key in keys:
            own = which[at : at + len(key)]
            at += len(key)
            out.append((key[again[own]].tobytes(), np.packbits(many[own][again[own]]).tobytes()))
        made = pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "keys": [o[0] for o in out], "many": [o[1] for o in out]})
        del keys, twice, every, known, which
        give_back()
        return made[made["keys"].str.len() > 0]

    return work


# -- pieces --------------------------------------------------------------------------------------
_PIECES = "kind int, block long, split long, chunk long, shards binary, ids binary, rows binary, starts binary, sizes binary, blob binary"
_CUTS = "chunk long, rows binary, starts binary, stops binary"


def _send_pieces(bits: int, shards: int, a_block: int, splits: int):
    def work(key, chunk: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        columns = ["kind", "block", "split", "chunk", "shards", "ids", "rows", "starts", "sizes", "blob"]
        if len(chunk):
            row = chunk.iloc[0]
            ends = np.asarray(row["ends"], dtype=np.int64)
            copies = set()
            wanted, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
            for bucket, keys, flag in zip(flags["bucket"], flags["keys"], flags["many"], strict=True):
                if bucket < 0:
                    copies.update(np.frombuffer(keys, dtype="<i8").tolist())
                else:
                    own = np.frombuffer(keys, dtype=np.uint32)
                    wanted.append((np.uint64(bucket) << np.uint64(32)) | own.astype(np.uint64))
                    many.append(np.unpackbits(np.frombuffer(flag, dtype=np.uint8), count=len(own)))
            wanted, many = np.concatenate(wanted), np.concatenate(many)
            order = np.argsort(wanted)
            wanted, many = wanted[order], many[order]
            if len(wanted):
                out = _pieces(row, ends, copies, wanted, many, bits, shards, a_block, splits)
        give_back()
        return pd.DataFrame(out, columns=columns)

    return work


def _pieces(row, ends, copies, wanted, many, bits, shards, a_block, splits) -> list[tuple]:
    text = _unpack(row["blob"])
    raw = text.tobytes()
    h, first, last = anchors(text, ends)
    key = _keys(h, bits)
    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    use = np.flatnonzero(wanted[at] == key)
    doc = np.searchsorted(ends, first[use], side="right")
    ids = [x for x in row["ids"]]
    ids = [None if x is None or x != x else int(x) for x in ids]
    free = np.array([i is not None and k not in copies for k, i in enumerate(ids)])
    number = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    keep = free[doc]
    use, doc = use[keep], doc[keep]
    # The smallest id first: it stands for all equal pieces of the chunk.
    order = np.argsort(number[doc])
    use, doc = use[order], doc[order]
    begin = np.concatenate(([0], ends[:-1]))
    shard = (mix64(key[use]) % np.uint64(shards)).astype(np.int64)
    split = np.where((many[at[use]] > 0) & (splits > 1), row["chunk"] % splits, -1)
    seen: dict[bytes, int] = {}
    sent: dict[tuple[int, int], list] = {}
    local: list[tuple[int, int, int]] = []
    for s, p, d, i, a, b in zip(shard.tolist(), split.tolist(), doc.tolist(), number[doc].tolist(), first[use].tolist(),
                                (last[use] + LENGTH).tolist(), strict=True):
        piece = raw[a:b]
        known = seen.setdefault(piece, i)
        if known < i:
            local.append((d, a - int(begin[d]), b - int(begin[d])))
        else:
            sent.setdefault((s // a_block, p), []).append((s % a_block, i, d, a - int(begin[d]), piece))
    chunk = int(row["chunk"])
    squeeze = zstandard.ZstdCompressor(level=1)
    out = []
    for (block, p), pieces in sent.items():
        s, i, d, a, blobs = zip(*pieces, strict=True)
        out.append((0, block, p, chunk, bytes(s), _pack8(i), _pack8(d), _pack8(a), bytes(map(len, blobs)), squeeze.compress(b"".join(blobs))))
    if local:
        d, a, b = zip(*local, strict=True)
        out.append((1, chunk % -(-shards // a_block), -1, chunk, b"", b"", _pack8(d), _pack8(a), _pack8(b), b""))
    return out


def _pack8(x) -> bytes:
    return np.asarray(x, dtype="<i8").tobytes()


def _unpack8(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<i8")


# -- suffix arrays -------------------------------------------------------------------------------
def suffix_array(t: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by eight bytes, then refine the groups still tied by the ranks twice as far on."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    key = as_strided(padded, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    sa = np.argsort(key)
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = key[sa[1:]] != key[sa[:-1]]
    rank = np.zeros(n + 1, dtype=np.int64)  # 0: past the end, before all others
    slots = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(new[:n], slots, 0)) + 1
    if n < 8 or (t == 0).any():
        # Zero bytes look like the end within the first eight: start from single bytes instead.
        return _doubling(t)
    step = 8
    while True:
        tied = np.flatnonzero(~(new[:n] & new[1:]))
        if not len(tied):
            return sa
        own = sa[tied]
        pair = rank[own] * (n + 2) + rank[np.minimum(own + step, n)]
        order = np.argsort(pair)
        own, pair = own[order], pair[order]
        sa[tied] = own
        fresh = np.ones(len(pair), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[tied] |= fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, tied, 0)) + 1
        step *= 2


def _doubling(t: np.ndarray) -> np.ndarray:
    n = len(t)
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[:n] = t.astype(np.int64) + 1
    step = 1
    while True:
        pair = rank[:n] * (n + 258) + rank[np.minimum(np.arange(n) + step, n)]
        sa = np.argsort(pair)
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = pair[sa[1:]] != pair[sa[:-1]]
        if fresh.all():
            return sa
        rank[sa] = np.cumsum(fresh)
        step *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """After Kasai: of the ``counts`` suffixes from each start on, the bytes (up to ``LENGTH``) shared with the one before.

    Each start is a lane that carries its prefix length from one suffix to the next, less one; lanes advance together.
    Suffixes outside of the lanes get -1.
    """
    n = len(t)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    out = np.full(n, -1, dtype=np.int64)
    shared = np.zeros(len(starts), dtype=np.int64)
    padded = np.concatenate((t, np.zeros(LENGTH + 1, np.uint8)))
    for step in range(int(counts.max(initial=0))):
        lanes = np.flatnonzero(counts > step)
        i = starts[lanes] + step
        j = before[i]
        have = np.maximum(shared[lanes] - 1, 0)
        have[j < 0] = 0
        more = np.flatnonzero((j >= 0) & (have < LENGTH))
        while len(more):
            a, b = i[more] + have[more], j[more] + have[more]
            same = (padded[a] == padded[b]) & (a < n) & (b < n)
            more = more[same]
            have[more] += 1
            more = more[have[more] < LENGTH]
        shared[lanes] = have
        out[i] = have
    return out


def _shard(pieces: dict[bytes, list[tuple[int, int, int, int]]], split: bool) -> tuple[np.ndarray, dict[str, bytes] | None]:
    """Removed parts (chunk, row, start, stop) of the pieces of one shard, given by their places (id, chunk, row, start); for split
    anchors also the sorted run of its distinct windows."""
    removed: list[tuple[int, int, int, int]] = []
    smallest = []
    for piece, places in pieces.items():
        least = min(places)[0]
        smallest.append(least)
        if len(places) > 1:
            removed += [(c, d, s, s + len(piece)) for i, c, d, s in places if i > least]
    t = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    sa = suffix_array(t)
    prefix = common_prefixes(t, sa, starts, counts)
    # Suffixes that start no window cannot stand between equal windows, or they would start with the same 50 bytes.
    window = np.zeros(len(t) + 1, dtype=np.int64)
    window[starts] += 1
    np.add.at(window, starts + counts, -1)
    window = np.cumsum(window[:-1]) > 0
    run_of = _runs(t, sa, window, prefix)
    at = np.flatnonzero(window)
    piece_of = np.searchsorted(starts, at, side="right") - 1
    doc = np.array(smallest, dtype=np.int64)[piece_of]
    group = run_of[at]
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    places = list(pieces.values())
    gone = at[doc > least[group]]
    if len(gone):
        owner = np.searchsorted(starts, gone, side="right") - 1
        head = np.ones(len(gone), dtype=bool)
        head[1:] = (gone[1:] != gone[:-1] + 1) | (owner[1:] != owner[:-1])
        tail = np.append(head[1:], True)
        for k, a, b in zip(owner[head].tolist(), gone[head].tolist(), gone[tail].tolist(), strict=True):
            a, b = a - int(starts[k]), b - int(starts[k]) + LENGTH
            removed += [(c, d, s + a, s + b) for i, c, d, s in places[k] if i == smallest[k]]
    run = _sorted_run(t, at, group, doc, least, piece_of, starts, places) if split else None
    return np.array(removed, dtype=np.int64).reshape(-1, 4), run


def _block(a_block: int):
    """All shards of one block, one after the other: a row of removed parts for each chunk, and the runs of split anchors."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        block, split = int(rows["block"].iloc[0]), bool(rows["split"].iloc[0] >= 0)
        columns = ["chunk", "rows", "starts", "stops", "shard", "strings", "docs", "entry", "chunks"]
        removed, runs = [np.zeros((0, 4), np.int64)], []
        for r in rows[rows["kind"] == 1].itertuples():
            d, a, b = map(_unpack8, (r.rows, r.starts, r.sizes))
            removed.append(np.column_stack((np.full(len(d), r.chunk), d, a, b)))
        sent = rows[rows["kind"] == 0]
        if len(sent):
            squeezed = zstandard.ZstdDecompressor()
            raw = b"".join(squeezed.decompress(blob) for blob in sent["blob"])
            shard, size = (np.frombuffer(b"".join(sent[c]), dtype=np.uint8) for c in ("shards", "sizes"))
            number, row, start = (np.frombuffer(b"".join(sent[c]), dtype="<i8") for c in ("ids", "rows", "starts"))
            chunk = np.repeat(sent["chunk"].to_numpy(), [len(x) for x in sent["shards"]])
            del sent, rows
            end = np.cumsum(size, dtype=np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(a_block + 1))
            for k in range(a_block):
                own = order[bounds[k] : bounds[k + 1]]
                if not len(own):
                    continue
                pieces: dict[bytes, list[tuple[int, int, int, int]]] = {}
                for b, n, *place in zip(*(x[own].tolist() for x in (end, size, number, chunk, row, start)), strict=True):
                    pieces.setdefault(raw[b - n : b], []).append(tuple(place))
                gone, run = _shard(pieces, split)
                removed.append(gone)
                if run and run["strings"]:
                    runs.append((-1, run["rows"], run["starts"], b"", block * a_block + k, run["strings"], run["docs"], run["entry"], run["chunks"]))
        cuts = np.concatenate(removed)
        cuts = cuts[np.argsort(cuts[:, 0], kind="stable")]
        heads = np.flatnonzero(np.diff(cuts[:, 0], prepend=-1))
        out = [(int(part[0, 0]), *(_pack8(part[:, c]) for c in (1, 2, 3)), -1, b"", b"", b"", b"") for part in np.split(cuts, heads[1:]) if len(part)]
        give_back()
        return pd.DataFrame(out + runs, columns=columns)

    return work


_BLOCK = "chunk long, rows binary, starts binary, stops binary, shard long, strings binary, docs binary, entry binary, chunks binary"


def _runs(t: np.ndarray, sa: np.ndarray, window: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Number of the run of equal windows at each window start."""
    # A suffix that starts no window but shares 50 bytes with its neighbours joins their run; compare those directly.
    other = np.flatnonzero(~window[sa])
    padded = np.concatenate((t, np.zeros(LENGTH, np.uint8)))
    joined = prefix[sa] >= LENGTH
    other = other[other > 0]
    if len(other):
        a, b = sa[other], sa[other - 1]
        inside = np.flatnonzero((a + LENGTH <= len(t)) & (b + LENGTH <= len(t)))
        for k in range(LENGTH):
            inside = inside[padded[a[inside] + k] == padded[b[inside] + k]]
        joined[other[inside]] = True
    joined[0] = False
    out = np.empty(len(t), dtype=np.int64)
    out[sa] = np.cumsum(~joined) - 1
    return out


def _sorted_run(t, at, group, doc, least, piece_of, starts, places) -> dict[str, bytes]:
    """Distinct windows in suffix order with their smallest id and the places of that id."""
    order = np.argsort(group, kind="stable")
    first = order[np.flatnonzero(np.diff(group[order], prepend=-1))]
    number = {int(g): k for k, g in enumerate(group[first])}
    raw = t.tobytes()
    entry, chunks, rows, begins = [], [], [], []
    for w in np.flatnonzero(doc == least[group]).tolist():
        k, offset = int(piece_of[w]), int(at[w] - starts[piece_of[w]])
        for i, c, d, s in places[k]:
            if i == doc[w]:
                entry.append(number[int(group[w])])
                chunks.append(c)
                rows.append(d)
                begins.append(s + offset)
    return {"strings": b"".join(raw[a : a + LENGTH] for a in at[first].tolist()), "docs": _pack8(least[group[first]]),
            "entry": _pack8(entry), "chunks": _pack8(chunks), "rows": _pack8(rows), "starts": _pack8(begins)}


def _merge_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Binary search of each sorted run in the others: windows with a smaller id elsewhere are removed here."""
    kind = f"S{LENGTH}"
    strings = [np.frombuffer(s, dtype=kind) for s in rows["strings"]]
    docs = [_unpack8(d) for d in rows["docs"]]
    cuts: dict[int, list] = {}
    for k, r in enumerate(rows.itertuples()):
        best = docs[k].copy()
        for m, other in enumerate(strings):
            if m != k and len(other):
                where = np.minimum(np.searchsorted(other, strings[k]), len(other) - 1)
                same = other[where] == strings[k]
                best[same] = np.minimum(best[same], docs[m][where[same]])
        entry = _unpack8(r.entry)
        hit = (best < docs[k])[entry]
        for c, d, a in zip(_unpack8(r.chunks)[hit].tolist(), _unpack8(r.rows)[hit].tolist(), _unpack8(r.starts)[hit].tolist(), strict=True):
            cuts.setdefault(c, []).append((d, a, a + LENGTH))
    out = [(c, *(_pack8(x) for x in zip(*parts, strict=True))) for c, parts in cuts.items()]
    return pd.DataFrame(out, columns=["chunk", "rows", "starts", "stops"])


def _by_part(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut sorted runs into parts by a hash of their strings, so that no task merges all of a shard's runs."""
    import zlib

    for frame in rows:
        out = []
        for r in frame.itertuples():
            strings = np.frombuffer(r.strings, dtype=f"S{LENGTH}")
            part = np.array([zlib.crc32(r.strings[k : k + LENGTH]) % _PARTS for k in range(0, len(r.strings), LENGTH)])
            docs, entry = _unpack8(r.docs), _unpack8(r.entry)
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                number = np.full(len(part), -1)
                number[own] = np.arange(len(own))
                keep = number[entry] >= 0
                out.append((r.shard, p, strings[own].tobytes(), _pack8(docs[own]), _pack8(number[entry][keep]),
                            *(_pack8(_unpack8(x)[keep]) for x in (r.chunks, r.rows, r.starts))))
        yield pd.DataFrame(out, columns=["shard", "part", "strings", "docs", "entry", "chunks", "rows", "starts"])


# -- results -------------------------------------------------------------------------------------
def _cut(with_text: bool):
    def work(key, chunk: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for row in chunk.itertuples():
            ends = np.asarray(row.ends, dtype=np.int64)
            begin = np.concatenate(([0], ends[:-1]))
            n = len(ends)
            parts = [(_unpack8(c.rows), _unpack8(c.starts), _unpack8(c.stops)) for c in cuts.itertuples()]
            rows, starts, stops = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            whole = stops < 0  # a copy of a text with a smaller id
            stops = np.where(whole, (ends - begin)[rows], stops)
            real = stops - starts >= LENGTH
            rows, starts, stops = rows[real], starts[real] + begin[rows[real]], stops[real] + begin[rows[real]]
            text = _unpack(row.blob) if len(rows) or with_text else np.zeros(0, np.uint8)
            change = np.zeros(int(ends[-1]) + 1 if n else 1, dtype=np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, stops, -1)
            touched = set(rows.tolist())
            gone = np.cumsum(change[:-1]) > 0 if touched else None
            for k in range(n):
                a, b = int(begin[k]), int(ends[k])
                own = gone[a:b] if k in touched else None
                digest, spans, removed = row.digests[k], 0, 0
                left = text[a:b]
                if own is not None:
                    left = left[~own]
                    removed = int(own.sum())
                    spans = int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1))
                    digest = hashlib.sha256(left.tobytes()).hexdigest()
                i = row.ids[k]
                out.append((None if i is None or i != i else int(i), b - a, removed, spans, digest,
                            *([left.tobytes()] if with_text else [])))
        made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if with_text else [])])
        return made.astype({"doc_id": "Int64"})

    return work


def remove_repeats(docs: DataFrame, with_text: bool = False, chunks_a_split: int = CHUNKS_A_SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes if asked for) of each row of ``docs``."""
    work = Scratch(docs.sparkSession, "repeats")
    packed = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _pack,
                       "chunk long, ids array<long>, ends array<long>, digests array<string>, blob binary")
    packed = work.write(packed, "chunks")
    size = packed.agg(F.sum(F.element_at("ends", -1)).alias("bytes"), F.count("*").alias("chunks")).first()
    total = size.bytes or 0
    bits = max(6, (total // BUCKET_BYTES).bit_length())
    shards, splits = max(64, total // SHARD_BYTES), -(-size.chunks // chunks_a_split)
    a_block = min(BLOCK_SHARDS, -(-shards // BLOCKS))
    counted = map_arrow(packed.select("chunk", "ends", "blob"), _count_anchors(bits), "bucket long, chunk long, keys binary, twice binary")
    repeated = counted.groupBy("bucket").applyInPandas(_repeated(chunks_a_split), "chunk long, bucket long, keys binary, many binary")
    repeated = work.write(repeated, "repeated")
    each = packed.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("row", "d")).selectExpr("chunk", "row", "d.ids AS id", "d.digests AS digest")
    least = each.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = work.write(each.join(least, "digest").where("id > least").groupBy("chunk").agg(
        F.collect_list(F.col("row").cast("long")).alias("rows")), "copies")
    pack = F.pandas_udf(lambda rows: rows.map(_pack8), "binary")
    flags = repeated.union(copies.select("chunk", F.lit(-1).cast("long"), pack("rows"), F.lit(b"")))
    pieces = packed.select("chunk", "ids", "ends", "blob").groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(
        _send_pieces(bits, shards, a_block, splits), _PIECES)
    found = work.write(pieces.groupBy("block", "split").applyInPandas(_block(a_block), _BLOCK), "found")
    cuts = found.where("chunk >= 0").select("chunk", "rows", "starts", "stops")
    if splits > 1:
        runs = found.where("chunk < 0").select("shard", "strings", "docs", "entry", "chunks", "rows", "starts").mapInPandas(
            _by_part, "shard long, part long, strings binary, docs binary, entry binary, chunks binary, rows binary, starts binary")
        cuts = cuts.union(runs.groupBy("shard", "part").applyInPandas(_merge_runs, _CUTS))
    whole = copies.select("chunk", pack("rows"), pack(F.transform("rows", lambda x: x * 0)), pack(F.transform("rows", lambda x: x * 0 - 1)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_text else "")
    return packed.groupBy("chunk").cogroup(cuts.union(whole).groupBy("chunk")).applyInPandas(_cut(with_text), schema)


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
