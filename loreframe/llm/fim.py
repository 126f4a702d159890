"""Fill-in-middle over seekable compressed frames.

Texts are stored as independent zstandard frames of about ``FRAME`` bytes, cut between code points, each with the
counts of code points (units) and bytes up to its end. A place in a text is found from the counts: only the frame that
holds it is decompressed. Ranges of a text are streamed frame by frame, so that a task holds one frame at a time beside
the compressed row, however long the text is.

A text is cut at two places drawn from a digest of its id into prefix, middle and suffix, which are put out between
markers: psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, plain is the
text. ``restored`` reads an output in that order and gives the text back; it knows the output and the form alone.

Nothing is shuffled: each task stores the rows it read, and reads rows back by file. A lost executor repeats tasks.

Cases: a null text is empty; empty texts, texts with a marker in them (also where it lies across two frames) and a share of
the others stay plain; a row without an id is drawn as if its id were the empty string; equal rows give equal rows; an
empty table gives an empty result; extra columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreframe.llm.shared import lean, scratch, utf8

FRAME, LEVEL = 1 << 16, 3
P, S, M = b"<P>", b"<S>", b"<M>"
SEED, PLAIN, SPM = 1, 10, 20
STORE = "doc_id long, units long, frames array<struct<units:bigint,bytes:bigint,data:binary>>"
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _heads(data: bytes | memoryview) -> np.ndarray:
    """Which bytes begin a code point."""
    return (np.frombuffer(data, np.uint8) & 0xC0) != 0x80


def frames_of(text: memoryview, compress: Callable[[bytes], bytes], size: int = FRAME) -> list[dict]:
    """The text's frames, each with the units and bytes up to its end."""
    out, at, units = [], 0, 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        part = bytes(text[at:end])
        units += int(np.count_nonzero(_heads(part)))
        out.append({"units": units, "bytes": end, "data": compress(part)})
        at = end
    return out


class Frames:
    """A stored text: places by units, ranges by bytes."""

    def __init__(self, frames: list[dict], decompress: Callable[[bytes], bytes]):
        self.frames, self.decompress = frames, decompress
        self.units = [0, *(f["units"] for f in frames)]
        self.bytes = [0, *(f["bytes"] for f in frames)]
        self.opened: list[int] = []
        self._held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = k, self.decompress(self.frames[k]["data"])
            self.opened.append(k)
        return self._held[1]

    def place(self, unit: int) -> int:
        """The byte at which a unit begins; of the frames only the one that holds it is decompressed."""
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        if self.units[k] == unit:
            return self.bytes[k]
        return self.bytes[k] + int(np.flatnonzero(_heads(self.frame(k)))[unit - self.units[k]])

    def stream(self, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from begin to end, a frame at a time."""
        end = self.bytes[-1] if end is None else end
        k = max(0, int(np.searchsorted(self.bytes, begin, side="right")) - 1)
        while k < len(self.frames) and self.bytes[k] < end:
            whole, base = self.frame(k), self.bytes[k]
            yield whole[max(0, begin - base) : end - base]
            k += 1

    def slice(self, begin: int, end: int) -> str:
        """The text from one unit to another."""
        return b"".join(self.stream(self.place(begin), self.place(end))).decode()

    def holds(self, *marks: bytes) -> bool:
        """Whether any mark is in the text, also across frames."""
        tail, most = b"", max(map(len, marks)) - 1
        for part in self.stream():
            seen = tail + part
            if any(m in seen for m in marks):
                return True
            tail = seen[-most:] if most else b""
        return False


def drawn(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def plan(doc_id: int | None, text: Frames, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> tuple[str, int | None, int | None]:
    """(form, units of the prefix, units of the middle)."""
    h, n = drawn(doc_id, seed), text.units[-1]
    if n == 0 or h[2] % 100 >= 100 - plain or text.holds(P, S, M):
        return "plain", None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("spm" if h[3] % 100 < spm else "psm"), a, b - a


def output(text: Frames, form: str, prefix: int | None, middle: int | None) -> Iterator[bytes]:
    """The output's bytes in order, a frame at a time."""
    if form == "plain":
        yield from text.stream()
        return
    a = text.place(prefix)
    b = text.place(prefix + middle)
    parts = {"psm": ((P, 0, a), (S, b, None), (M, a, b)), "spm": ((S, b, None), (P, 0, a), (M, a, b))}[form]
    for mark, begin, end in parts:
        yield mark
        yield from text.stream(begin, end)


def _parts(pieces: Iterator[bytes], marks: tuple[bytes, ...]) -> Iterator[tuple[int, bytes]]:
    """(which mark it follows, bytes) of an output in pieces: marks are met in order, also where they lie across pieces."""
    at, rest = -1, b""
    for piece in pieces:
        rest += piece
        while at + 1 < len(marks) and (k := rest.find(marks[at + 1])) >= 0:
            if k:
                yield at, rest[:k]
            at, rest = at + 1, rest[k + len(marks[at + 1]) :]
        keep = len(marks[at + 1]) - 1 if at + 1 < len(marks) else 0
        if len(rest) > keep:
            yield at, rest[: len(rest) - keep]
            rest = rest[len(rest) - keep :]
    if rest:
        yield at, rest


def restored(pieces: Iterator[bytes], form: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes], bytes]) -> Iterator[bytes]:
    """The text from the output's bytes and form; the suffix, which is put out before the middle, waits as compressed frames."""
    if form == "plain":
        yield from pieces
        return
    marks, suffix = ((P, S, M), 1) if form == "psm" else ((S, P, M), 0)
    waiting = []
    for at, part in _parts(pieces, marks):
        if at < 0:
            raise ValueError("the output does not begin with a marker")
        if at == suffix:
            waiting.append((len(part) > 1024, compress(part) if len(part) > 1024 else part))
        else:
            yield part
    for packed, part in waiting:
        yield decompress(part) if packed else part


def _coder() -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress


def _frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress, _ = _coder()
    kind = pa.list_(pa.struct([("units", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            data, offsets = utf8(batch.column("text"))
            view = memoryview(data)
            lists = [frames_of(view[a:b], compress) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            units = [f[-1]["units"] if f else 0 for f in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(units, pa.int64()), pa.array(lists, kind)], names=["doc_id", "units", "frames"])


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store every text as frames at path."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(lean(_frame), STORE).write.option("compression", "uncompressed").parquet(path)


def _transform(seed: int, plain: int, spm: int, texts: bool) -> Callable:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.large_string()]
    names = [*(c.split()[0] for c in COLUMNS.split(", ")), "output"]
    n = 8 if texts else 7

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, decompress = _coder()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch, rows = whole.slice(at, 200), []
                for doc_id, units, frames in zip(*[batch.column(c) for c in ("doc_id", "units", "frames")], strict=True):
                    text = Frames(frames.as_py(), decompress)
                    form, prefix, middle = plan(doc_id.as_py(), text, seed, plain, spm)
                    sha, back, kept = hashlib.sha256(), hashlib.sha256(), []

                    def told(pieces: Iterator[bytes], sha=sha, kept=kept) -> Iterator[bytes]:
                        for piece in pieces:
                            sha.update(piece)
                            if texts:
                                kept.append(piece)
                            yield piece

                    for piece in restored(told(output(text, form, prefix, middle)), form, compress, decompress):
                        back.update(piece)
                    row = (doc_id.as_py(), units.as_py(), form, prefix, middle, sha.hexdigest(), back.hexdigest())
                    rows.append((*row, b"".join(kept).decode()) if texts else row)
                columns = list(zip(*rows, strict=True)) or [[]] * n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[:n], strict=True)], names=names[:n])

    return go


def read(spark: SparkSession, path: str, seed: int = SEED, plain: int = PLAIN, spm: int = SPM, texts: bool = False) -> DataFrame:
    """COLUMNS of every stored text, and with ``texts`` the output itself."""
    return spark.read.schema(STORE).parquet(path).mapInArrow(lean(_transform(seed, plain, spm, texts)), COLUMNS + ", output string" * texts)


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store docs as frames below the shared folder and transform what the frames hold; plain and spm are percentages."""
    path = scratch(docs.sparkSession, "frames")
    write(docs, path, id_col, text_col)
    return read(docs.sparkSession, path, seed, plain, spm, texts)


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select doc_id, t, length(t)::bigint as n, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2,
        ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from d),
f as (select *, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
        least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from h),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
