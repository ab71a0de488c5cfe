"""Fill-in-the-middle transformation over texts stored as seekable compressed frames.

``store`` keeps a text as independent zstandard frames of at most ``FRAME`` bytes, each with the units (lines), code points
and bytes before it. ``transform`` finds a cut by bisection over the unit counts and decompresses the one frame it falls into;
all other frames go into the output as they are, only cut ones are compressed anew. ``digests`` streams the frames of an
output in order, so no output is ever whole in memory, and rebuilds the text from output and form.

Cuts, form and order follow a hash of seed and id alone, so reruns and retried tasks agree.

Defined cases: a null text counts as empty; an empty text, or one that holds a mark, is ``plain``: its output is the text. A
null id counts as the empty string in the hash. Rows of one id are cut by the same numbers, equal rows equally. A text without
a line end is one unit, a very long one many frames of which two are open at once. An empty table gives no rows. Other columns
are kept; those named like a column made here are replaced.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, types as T

from crawlgrain.llm.common import Scratch, kept_columns, map_arrow, read_table, text_bytes, text_slices

#: Bytes of text in one frame.
FRAME = 1 << 16
SEED = 7
#: Of a hundred documents, those transformed, and of these those with the suffix first.
FIM_RATE, SPM_RATE = 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
# Bytes of opened frames that a reader keeps.
HELD = 1 << 18

_FRAME_TYPE = "array<struct<units:bigint,chars:bigint,bytes:bigint,size:int,data:binary>>"
STORED = f"units long, chars long, marked boolean, frames {_FRAME_TYPE}"
MADE = f"form string, prefix_chars long, middle_chars long, output {_FRAME_TYPE}"
_ARROW_FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("size", pa.int32()), ("data", pa.binary())])


@functools.cache
def _tools() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def count_chars(raw: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return len(raw) if raw.isascii() else int(np.count_nonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80))


class Writer:
    """Appends bytes, or whole frames of another text, as frames with the counts before them."""

    def __init__(self):
        self.units = self.chars = self.bytes = 0
        self.frames: list[tuple] = []

    def add(self, raw: bytes) -> None:
        start = 0
        while start < len(raw):
            stop = min(len(raw), start + FRAME)
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop -= 1
            part = raw[start:stop]
            self._append(part.count(b"\n"), count_chars(part), len(part), _tools()[0].compress(part))
            start = stop

    def take(self, source: Frames, k: int) -> None:
        """Frame ``k`` of another text, still compressed."""
        self._append(*source.held_counts(k), source.rows[k]["data"])

    def _append(self, units: int, chars: int, size: int, data: bytes) -> None:
        self.frames.append((self.units, self.chars, self.bytes, size, data))
        self.units, self.chars, self.bytes = self.units + units, self.chars + chars, self.bytes + size


class Frames:
    """A stored text: opens frames when they are needed and keeps few of them."""

    def __init__(self, rows: list[dict], units: int = 0, chars: int = 0):
        self.rows, self.ends = rows, (units, chars)
        self.before = [r["units"] for r in rows]
        self.starts = [r["bytes"] for r in rows]
        self.size = rows[-1]["bytes"] + rows[-1]["size"] if rows else 0
        self._open: dict[int, bytes] = {}

    def held_counts(self, k: int) -> tuple[int, int, int]:
        """Units that end in frame ``k``, its code points and bytes."""
        this = self.rows[k]
        after = (self.rows[k + 1]["units"], self.rows[k + 1]["chars"]) if k + 1 < len(self.rows) else self.ends
        return after[0] - this["units"], after[1] - this["chars"], this["size"]

    def read(self, k: int) -> bytes:
        if k not in self._open:
            if sum(map(len, self._open.values())) > HELD:
                self._open.clear()
            self._open[k] = _tools()[1].decompress(self.rows[k]["data"])
        return self._open[k]

    def cut(self, units: int) -> tuple[int, int, int]:
        """(byte, code point, frame) at which the first ``units`` line ends are passed; one frame is opened."""
        if not units:
            return 0, 0, 0
        k = bisect.bisect_left(self.before, units) - 1
        raw, at = self.read(k), -1
        for _ in range(units - self.before[k]):
            at = raw.find(b"\n", at + 1)
            if at < 0:
                raise ValueError("the counts of a frame are wrong")
        return self.starts[k] + at + 1, self.rows[k]["chars"] + count_chars(raw[: at + 1]), k

    def stream(self, start: int, stop: int) -> Iterator[bytes]:
        """Bytes ``start`` to ``stop``, frame by frame."""
        k = max(0, bisect.bisect_right(self.starts, start) - 1)
        while start < stop:
            raw = self.read(k)[start - self.starts[k] : stop - self.starts[k]]
            yield raw
            start, k = start + len(raw), k + 1

    def copy(self, start: int, stop: int, to: Writer) -> None:
        """Bytes ``start`` to ``stop``: whole frames as they are, cut ones anew."""
        k = max(0, bisect.bisect_right(self.starts, start) - 1)
        while start < stop:
            end = self.starts[k] + self.rows[k]["size"]
            if start == self.starts[k] and end <= stop:
                to.take(self, k)
            else:
                to.add(self.read(k)[start - self.starts[k] : stop - self.starts[k]])
            start, k = min(end, stop), k + 1


# -- the operator --------------------------------------------------------------------------------
def _schema(df: DataFrame, made: str, drop: tuple[str, ...] = ()) -> tuple[list[str], T.StructType]:
    new = T.StructType.fromDDL(made)
    kept = kept_columns(df, (*new.names, *drop))
    return kept, T.StructType([*(df.schema[c] for c in kept), *new])


def _frame_lists(lists: list[list[tuple]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    flat = [f for frames in lists for f in frames]
    columns = list(zip(*flat, strict=True)) or [()] * 5
    parts = [pa.array(c, type=f.type) for c, f in zip(columns, _ARROW_FRAME, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_ARROW_FRAME)))


def store(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by its ``frames``, the number of ``units`` and ``chars`` and whether it is ``marked``."""
    kept, schema = _schema(docs, STORED, ("text",))
    wanted = docs.select(*[docs[c] for c in kept], docs["text"])

    def work(batches):
        for batch in text_slices(b.rename_columns([*kept, "text"]) for b in batches):
            units, chars, marked, frames = [], [], [], []
            for raw in text_bytes(batch.column("text")):
                raw, to = raw or b"", Writer()
                to.add(raw)
                units.append(to.units + bool(raw and not raw.endswith(b"\n")))
                chars.append(to.chars)
                marked.append(any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)))
                frames.append(to.frames)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(kept))), pa.array(units, pa.int64()), pa.array(chars, pa.int64()),
                 pa.array(marked, pa.bool_()), _frame_lists(frames)], names=schema.names)

    return map_arrow(wanted, work, schema)


def numbers(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def choose(seed: int, doc_id: int | None, n: int, plain: bool, fim_rate: int, spm_rate: int) -> tuple[str, int, int]:
    """(form, units before the middle, units up to its end)."""
    h1, h2, h3, h4 = numbers(seed, doc_id)
    if plain or not n or h3 % 100 >= fim_rate:
        return "plain", 0, 0
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < spm_rate else "psm", first, second


def rearrange(text: Frames, n: int, form: str, first: int, second: int) -> tuple[Writer, int | None, int | None]:
    """The output's frames, and the code points of prefix and middle."""
    to = Writer()
    if form == "plain":
        text.copy(0, text.size, to)
        return to, None, None
    cuts = [(text.size, text.ends[1]) if units == n else text.cut(units)[:2] for units in (first, second)]
    (a, a_chars), (b, b_chars) = cuts
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, text.size)}
    for mark in ORDERS[form]:
        to.add(mark)
        text.copy(*spans[mark], to)
    return to, a_chars, b_chars - a_chars


def transform(stored: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The rows of ``store`` with ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` in place of the text's frames."""
    kept, schema = _schema(stored, MADE, ("frames", "chars", "marked"))
    wanted = stored.select(*[stored[c] for c in kept], "doc_id", "units", "chars", "marked", "frames")

    def work(batches):
        for batch in batches:
            asked = {c: batch.column(len(kept) + k) for k, c in enumerate(("doc_id", "units", "chars", "marked", "frames"))}
            for part in _by_size(asked["frames"]):
                rows = zip(*(asked[c].slice(*part).to_pylist() for c in asked), strict=True)
                forms, prefix, middle, output = [], [], [], []
                for doc_id, units, chars, marked, frames in rows:
                    text = Frames(frames, units, chars)
                    form, first, second = choose(seed, doc_id, units, marked, fim_rate, spm_rate)
                    to, a, b = rearrange(text, units, form, first, second)
                    forms.append(form), prefix.append(a), middle.append(b), output.append(to.frames)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(*part) for k in range(len(kept))), pa.array(forms, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _frame_lists(output)], names=schema.names)

    return map_arrow(wanted, work, schema)


def _by_size(lists: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts whose frames hold about ``size`` bytes of text, one row at least."""
    sizes = np.concatenate(([0], np.cumsum(lists.flatten().field("size").to_numpy(), dtype=np.int64)))
    ends = sizes[np.cumsum(pc.list_value_length(lists).to_numpy())]
    start = 0
    while start < len(lists):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield start, stop - start
        start = stop


def marks(output: Frames, form: str) -> list[int]:
    """Where the marks of a form stand in its output, found frame by frame."""
    found, carry, at = [], b"", 0
    wanted = list(ORDERS[form])
    for raw in output.stream(0, output.size):
        held, begin, done = carry + raw, at - len(carry), 0
        while wanted and (k := held.find(wanted[0], done)) >= 0:
            found.append(begin + k)
            done = k + len(wanted.pop(0))
        carry, at = held[max(done, len(held) - len(PREFIX) + 1) :], at + len(raw)
    if wanted:
        raise ValueError(f"an output of form {form} lacks {wanted[0].decode()}")
    return found


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text, rebuilt from its output and form alone."""
    if form == "plain":
        yield from output.stream(0, output.size)
        return
    at = dict(zip(ORDERS[form], marks(output, form), strict=True))
    after = sorted([*at.values(), output.size])
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(at[mark] + len(mark), after[after.index(at[mark]) + 1])


def _sha256(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def digests(made: DataFrame) -> DataFrame:
    """The rows of ``transform`` with ``output_sha256`` and ``restored_sha256`` in place of the output's frames."""
    kept, schema = _schema(made, "output_sha256 string, restored_sha256 string", ("output",))
    wanted = made.select(*[made[c] for c in kept], made["form"].alias("form_"), "output")

    def work(batches):
        for batch in batches:
            form, output = (batch.column(len(kept) + k) for k in range(2))
            for part in _by_size(output):
                out, back = [], []
                for name, frames in zip(form.slice(*part).to_pylist(), output.slice(*part).to_pylist(), strict=True):
                    made = Frames(frames)
                    out.append(_sha256(made.stream(0, made.size)))
                    back.append(_sha256(restored(made, name)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(*part) for k in range(len(kept))), pa.array(out, pa.string()), pa.array(back, pa.string())],
                    names=schema.names)

    return map_arrow(wanted, work, schema)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: units, form, code points of prefix and middle, digests of the output and of the text rebuilt from it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = Scratch(spark, "fim").write(store(docs), "frames")
    return digests(transform(stored)).selectExpr(
        "doc_id", "units AS n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE = rf"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
    FROM documents),
drawn AS (
    SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM hashed),
formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {FIM_RATE} THEN 'plain'
                WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
cut AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
           array_to_string(units[b + 1:], '') AS suffix
    FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""
