"""Token ids in Parquet list columns.

Rows are range-partitioned and sorted by id, encoded in Arrow batches and written one file a partition:
ids as a dictionary-encoded list column, the small columns dictionary- or delta-encoded in version 2 pages,
with row groups of bounded size and page indexes over pages of bounded row count, so that a reader can take
the metadata alone or the ids of a range of documents. Each row has its start within its file; a reader adds
the tokens of the files before.

Where the tokenizer drops white space and never joins across it, nor between ASCII letters, digits and marks (this is
tried on it, see ``Encoder``), a text's ids are its pieces' ids in a row: the pieces of a batch are dictionary-encoded,
and what is new is encoded once a worker and then looked up. The table of pieces is of fixed size: when it is full, the
pieces that were met in more than one batch stay. Other tokenizers, and texts with special tokens in them, encode whole
texts.

Cases: a null text is empty and has the end id only; null ids come first; rows with one id are ordered by a
hash of their text; an empty table makes no rows. Extra columns are kept if named in ``keep``, unless they have the
name of one of the files' own columns, which is refused.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.llm.shared import lean, pieces, scratch, utf8

END = 2
MOST_WORDS = 300_000
#: Texts that are encoded together, in bytes.
BATCH_BYTES = 4 << 20
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
}
_tokenizers: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# letters a-z, marks and digits of ASCII; white space; and what is cut from nothing: apostrophes and other bytes
_OTHER, _LETTER, _MARK, _DIGIT, _SPACE = range(5)
_KIND = np.array([_LETTER if 97 <= b <= 122 else _DIGIT if 48 <= b <= 57 else _SPACE if b in b" \t\n\v\f\r" else _MARK if 33 <= b <= 126 and b != 39 and not 65 <= b <= 90 else _OTHER for b in range(256)], np.uint8)
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on."""
    plain = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b if own else 256 + b - sum(plain[:b])) for b, own in enumerate(plain)]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces with A-Z lower-cased, the n + 1 bounds of the rows in them)."""
    low = _LOW[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    n, kind = len(low), _KIND[low]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    left, right = kind[:-1], kind[1:]
    fresh[1:n] |= (left != right) & (left != _OTHER) & (right != _OTHER) | (left == _DIGIT) & (right == _DIGIT) | (left == _SPACE) | (right == _SPACE)
    solid = kind != _SPACE
    starts = np.flatnonzero(fresh[:n] & solid)
    # where the pieces begin once white space is taken out
    places = np.append((np.cumsum(solid) - 1)[starts], np.count_nonzero(solid)).astype(np.int32) if n else np.zeros(1, np.int32)
    pieces_ = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(low[solid])])
    return pieces_, np.searchsorted(starts, offsets)


class Encoder:
    """The ids of texts by a tokenizer's file, with a table of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()
        letters = _byte_letters()
        self.letters = {b: x for b, x in enumerate(letters) if ord(x) != b}
        probes = [x + y for x in map(chr, range(33, 127)) for y in map(chr, range(33, 127))]
        probes += [f"{x}{space}{y}" for x in ("Word", "it's", "12.", "\u00c9t\u00e9,", "\u1112") for y in ("'s", "$x", "\u0301b", "\u1161,", "\u4e2d") for space in " \t\n\v\f\r"]
        try:
            found = [self.model_ids(w) for w in ("q", "word", "\u00e9t\u00e9", "\u4e2d")]
            self.direct = found == self.ids(["q", "word", "\u00e9t\u00e9", "\u4e2d"])
        except Exception:  # a model without the letters of bytes
            self.direct = False
        own, bounds = cut(*utf8(pa.array(probes)))
        each = self.ids([x.decode() for x in own.to_pylist()])
        self.by_pieces = all(ids == sum(each[a:b], []) for ids, a, b in zip(self.ids(probes), bounds[:-1], bounds[1:], strict=True))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def model_ids(self, word: str) -> list[int]:
        """A word of lower-case composed letters is one piece for the model."""
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def fresh(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = [self.direct and t.isalpha() and (t.isascii() or (t == t.lower() and unicodedata.is_normalized("NFC", t))) for t in texts]
        rest = iter(self.ids([t for t, p in zip(texts, plain, strict=True) if not p]))
        for w, t, p in zip(words, texts, plain, strict=True):
            self.known[w] = np.array(self.model_ids(t) if p else next(rest), "<i4").tobytes()

    def looked_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in a row, how many each has)."""
        old = [w for w in words if w in self.known]
        self.again.update(old)
        if len(self.known) + len(words) - len(old) > MOST_WORDS:
            stay = self.again if 2 * len(self.again) <= MOST_WORDS else set(old)
            self.known, self.again = {w: self.known[w] for w in stay}, set()
        self.fresh([w for w in words if w not in self.known])
        found = [self.known[w] for w in words]
        return np.frombuffer(b"".join(found), "<i4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts in a row, how many each has)."""
        whole = np.full(len(column), not self.by_pieces)
        for mark in self.special if self.by_pieces else ():
            whole |= pc.fill_null(pc.match_substring(column, mark), False).to_numpy(zero_copy_only=False)
        rest = pc.if_else(pa.array(~whole), column, "") if whole.any() else column
        pieces_, bounds = cut(*utf8(rest))
        coded = pieces_.dictionary_encode()
        flat, sizes = self.looked_up(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        counts, begins = sizes[at], (np.cumsum(sizes) - sizes)[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])]
        ends = ends[bounds]
        if whole.any():
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for i, own in zip(np.flatnonzero(whole), self.ids([column[int(i)].as_py() or "" for i in np.flatnonzero(whole)]), strict=True):
                parts[i] = np.array(own, "<i4")
            return np.concatenate([np.zeros(0, "<i4"), *parts]), np.array([len(x) for x in parts], np.int64)
        return ids, np.diff(ends)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer's file."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def _encode(path: str, end: int, keep: list[str], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, at = encoder(path), 0
        for whole in batches:
            texts = whole.column("text").cast(pa.large_string())
            _, offsets = utf8(texts)
            for i, j in pieces(offsets, BATCH_BYTES):
                batch = whole.slice(i, j - i)
                ids, counts = encode(texts.slice(i, j - i))
                ends = np.cumsum(counts)
                ids, counts = np.insert(ids, ends, end), counts + 1
                offsets_ = np.concatenate([[0], np.cumsum(counts)])
                columns = [*[batch.column(c) for c in keep], pa.array(counts), pa.array(at + offsets_[:-1]), pa.ListArray.from_arrays(pa.array(offsets_.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                at += int(offsets_[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> None:
    from pyspark.sql.pandas.types import to_arrow_schema

    if {"ids", "n_tokens", "local_start", "text"} & {id_col, *keep}:
        raise ValueError("ids, n_tokens, local_start and text are names of the files' own columns")
    wanted = docs.select(id_col, *keep, F.col(text_col).alias("text"))
    names = [id_col, *keep]
    ranged = wanted.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, F.xxhash64("text"))
    out = wanted.select(*names, F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("local_start"), F.array(F.lit(0)).alias("ids")).schema
    ranged.mapInArrow(lean(_encode(tokenizer, end, names, to_arrow_schema(out))), out).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with the file's number; take the columns you need."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return spark.read.parquet(path).select("*", number.alias("file"))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its number and the tokens of all files before it."""
    ends = read(spark, path).groupBy("file").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ends.select("file", before.alias("before"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = [batch.column(c) for c in ("doc_id", "n_tokens", "local_start", "file")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crcs, pa.int64())], names=["doc_id", "n_tokens", "local_start", "file", "ids_crc32"])


def digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the files."""
    rows = read(spark, path).select(F.col(id_col).cast("long").alias("doc_id"), "n_tokens", "local_start", "file", "ids")
    small = rows.mapInArrow(lean(_digest), "doc_id long, n_tokens long, local_start long, file long, ids_crc32 long")
    return small.join(starts(spark, path), "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs' ids below the shared folder and give the digests of what the files hold."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, tokenizer or default_tokenizer())
    return digests(docs.sparkSession, path)
