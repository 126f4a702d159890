"""Media columns stored as content-defined chunks.

A text's payload (UTF-8, padded with spaces to a positive multiple of 192 bytes) is wrapped as 8-bit mono WAV
samples. A rolling gear hash over the last 32 bytes cuts the media into chunks of 512 bytes to 16 KB where its
top bits are zero. Chunks are known by their SHA-256 digest. One store holds:

- ``media``: a row for each document, with the ordered chunk list (digest, length) and, for chunks that no
  other document has, their bytes;
- ``chunks``: every other chunk once.

The digests of all chunks are counted by a Spark aggregation; those that occur more than once go into a Bloom
filter of about ``BITS_EACH`` bits for each, sized by their count, that is sent to the writing tasks. What the filter holds, its
rare false positives included, is written by digest to ``chunks``; so hardly more than repeated bytes are shuffled, and every
chunk is stored once. The filter has 2**``MOST_BITS`` bits (128 MB) at most: beyond some hundred million repeated digests its
false positives grow, which costs shuffled bytes and changes no result. Reading joins chunk lists to ``chunks`` by digest, once for each distinct
media, puts the chunks in order, verifies lengths and digests, and takes the payload out of the WAV form.

Cases: a null text is an empty one (192 spaces); equal texts give equal values; a document longer than a chunk's
bound has more chunks, however long; rows without an id are stored like others; empty tables give empty
results; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreframe.llm.shared import hot_join, hot_keys, lean, scratch, splitmix, stored, utf8

UNIT, RATE = 192, 8000
LEAST, MASK_BITS, MOST = 512, 12, 16_384
BITS_EACH, LEAST_BITS, MOST_BITS, BLOOM_HASHES = 10, 16, 30, 4
_GEAR = (splitmix(np.arange(256, dtype=np.uint64) + np.uint64(9)) >> np.uint64(32)).astype(np.uint32)
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
CHUNKS = "array<struct<digest:binary,length:int,bytes:binary>>"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % UNIT or (UNIT if not text else 0))


def to_media(payload: bytes) -> bytes:
    """8-bit mono WAV."""
    return _HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_media(media: bytes) -> bytes:
    head = _HEADER.unpack_from(media)
    if head[0] != b"RIFF" or head[11] != b"data" or head[12] != len(media) - _HEADER.size:
        raise ValueError("not a whole 8-bit WAV")
    return media[_HEADER.size :]


def cuts(media: bytes) -> list[int]:
    """Where chunks end. The hash at a byte depends on the 32 bytes before it alone, so equal passages cut alike."""
    if len(media) <= LEAST:
        return [len(media)]
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    marks = (np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1).tolist()
    out, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            out.append(m)
            last = m
    while len(media) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(media):
        out.append(len(media))
    return out


def _each(column: pa.Array) -> Iterator[tuple[bytes, bytes, list[bytes]]]:
    """(text, media, chunks) of each row."""
    data, offsets = utf8(column)
    data = data.tobytes() if len(data) < 1 << 26 else memoryview(data)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        text = bytes(data[a:b])
        media = to_media(payload_of(text))
        ends = cuts(media)
        yield text, media, [media[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[bytes, int] = {}
        for _, _, chunks in _each(batch.column("text")):
            for c in chunks:
                d = hashlib.sha256(c).digest()
                counts[d] = counts.get(d, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "held"])


def bits_of(digest: bytes, bits: int) -> list[int]:
    return [x & ((1 << bits) - 1) for x in struct.unpack("<4Q", digest)[:BLOOM_HASHES]]


def repeated_filter(rows: DataFrame) -> np.ndarray:
    """The Bloom filter of the digests that occur more than once, as 64-bit words: a power of two of them."""
    counted = rows.mapInArrow(lean(_digests), "digest binary, held long").groupBy("digest").agg(F.sum("held").alias("held")).where("held > 1")
    counted = stored(counted.select("digest"), "repeated-digests")
    size = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * counted.count()).bit_length()))
    # the same bits as bits_of: little-endian words of the digest
    place = lambda k: F.conv(F.concat(*[F.hex(F.substring("digest", 8 * k + i, 1)) for i in (4, 3, 2, 1)]), 16, 10).cast("long").bitwiseAND((1 << size) - 1)
    bits = counted.select(F.explode(F.array(*[place(k) for k in range(BLOOM_HASHES)])).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def repeated_in(bloom: np.ndarray, digest: bytes) -> bool:
    return all(int(bloom[b >> 6]) >> (b & 63) & 1 for b in bits_of(digest, len(bloom).bit_length() + 5))


def _media(bloom: np.ndarray) -> Callable:
    """Documents with their chunk lists, and the bytes of the chunks that the filter doesn't hold."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("bytes", pa.binary())]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, shas, lists = [], [], []
                for text, media, chunks in _each(batch.column("text")):
                    sizes.append(len(text))
                    shas.append(hashlib.sha256(media).digest())
                    named = [(hashlib.sha256(c).digest(), c) for c in chunks]
                    lists.append([{"digest": d, "length": len(c), "bytes": None if repeated_in(bloom, d) else c} for d, c in named])
                columns = [batch.column("id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(lists, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "media", "chunks"])

    return go


def _chunks(bloom: np.ndarray) -> Callable:
    """The chunks that the filter holds, each once a batch."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                found: dict[bytes, bytes] = {}
                for _, _, chunks in _each(whole.slice(at, 1000).column("text")):
                    found |= {d: c for c in chunks if repeated_in(bloom, d := hashlib.sha256(c).digest())}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "bytes"])

    return go


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store each row's text as media at path."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bloom = repeated_filter(rows)
    # documents stay where they are; only the repeated chunks are shuffled
    rows.mapInArrow(lean(_media(bloom)), f"id long, n_bytes long, media binary, chunks {CHUNKS}").write.option("compression", "zstd").parquet(f"{path}/media")
    rows.mapInArrow(lean(_chunks(bloom)), "digest binary, bytes binary").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")


def facts(media: bytes, n_bytes: int) -> tuple:
    """The columns of FEATURES from stored bytes."""
    payload = from_media(media)
    tail = payload[-16:]
    samples = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    feature = f"mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)};energy={int((samples.astype(np.int64) ** 2).sum()) // len(samples)};crossings={crossings}"
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


_FACT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_FACT_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def assembled(chunks: list[dict], media: bytes) -> bytes:
    """The media from its ordered chunks, verified chunk by chunk and as a whole."""
    for c in chunks:
        if c["bytes"] is None or len(c["bytes"]) != c["length"] or hashlib.sha256(c["bytes"]).digest() != c["digest"]:
            raise ValueError("a chunk is missing or damaged")
    out = b"".join(c["bytes"] for c in chunks)
    if hashlib.sha256(out).digest() != media:
        raise ValueError("the media is damaged")
    return out


def _facts(key: str) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [facts(assembled(c, m), n) for c, m, n in zip(*[batch.column(x).to_pylist() for x in ("chunks", "media", "n_bytes")], strict=True)]
                columns = list(zip(*rows, strict=True)) or [[]] * len(_FACT_NAMES)
                yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, t) for c, t in zip(columns, _FACT_TYPES, strict=True)]], names=[key, *_FACT_NAMES])

    return go


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id and FEATURES) of every stored row, from the stored bytes."""
    docs = spark.read.parquet(f"{path}/media")
    missing = F.exists("chunks", lambda c: c["bytes"].isNull())
    whole = docs.where(~missing).select("id", "n_bytes", "media", "chunks").mapInArrow(lean(_facts("id")), f"id long, {FEATURES}")
    parts = docs.where(missing)
    lists = parts.select("media", "chunks").dropDuplicates(["media"])
    pieces = lists.select("media", F.posexplode("chunks").alias("at", "chunk"))
    pieces = pieces.select("media", "at", F.col("chunk.digest").alias("digest"), F.col("chunk.length").alias("length"), F.col("chunk.bytes").alias("own"))
    joined = pieces.join(spark.read.parquet(f"{path}/chunks"), "digest", "left")
    piece = F.struct("at", F.struct("digest", "length", F.coalesce("own", "bytes").alias("bytes")).alias("chunk"))
    ordered = joined.groupBy("media").agg(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["chunk"]).alias("chunks"))
    # texts that differ in the spaces of the padding share a media: n_bytes is each row's own
    known = ordered.select("media", F.lit(0).cast("long").alias("n_bytes"), "chunks").mapInArrow(lean(_facts("media")), f"media binary, {FEATURES}").drop("n_bytes")
    # a media that very many rows share is dealt over several tasks
    counts = stored(parts.groupBy("media").agg(F.count("*").alias("held")), "shared-media")
    shared = hot_join(parts.select("id", "n_bytes", "media"), known, "media", hot_keys(counts, "media", "held"), "id", "inner")
    return whole.unionByName(shared.drop("media")).withColumnRenamed("id", "doc_id")


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store docs below the shared folder and read them back."""
    path = scratch(docs.sparkSession, "media")
    write(docs, path, id_col, text_col)
    return read(docs.sparkSession, path)
