"""Helpers that several operators share: scratch tables, words, shingle hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; where none is set, one of our own in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting by which a finished query's shuffle files go at once, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage, survives lost executors, and frees the shuffle files."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable) -> Callable:
    """run for mapInArrow, giving freed memory back to the system when a task ends: workers are kept from stage to stage."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return go


def n_words(text: str | Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values."""
    if np.ndim(x) == 0:  # scalars warn where arrays wrap
        return splitmix(np.array([x], np.uint64))[0]
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower-case letters, digits, and bytes beyond ASCII.
_CORE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Of each byte whether it is in a word, and the value of its lower-case form.
_SOLID, _LOW_VALUES = (~_IS_SPACE).astype(np.uint8).tobytes(), _VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, _PIECE)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, most: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes stay below a bound, or single rows."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """Hashes of all words of some rows: word k of row i is at bounds[i] + k."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(data)
        solid = np.frombuffer(data.tobytes().translate(_SOLID), bool)
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | fresh[1:n]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | fresh[1:n]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        up, down = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOW_VALUES[data] * up[:n], out=total[1:])
        self._total, self._down, self._data = total, down, data
        self.hashes = splitmix((total[self.stops] - total[self.starts]) * down[self.starts] + (self.stops - self.starts).astype(np.uint64))

    def cores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, start, stop) of the words without the ASCII marks around them; words of marks alone are left out."""
        at = np.flatnonzero(_CORE[_LOWER[self._data]])
        first, last = np.searchsorted(at, self.starts), np.searchsorted(at, self.stops) - 1
        whole = np.flatnonzero(first <= last)
        return whole, at[first[whole]], at[last[whole]] + 1

    def hashes_of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes."""
        return splitmix((self._total[stops] - self._total[starts]) * self._down[starts] + (stops - starts).astype(np.uint64) + np.uint64(1 << 33))

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, first word's index) of each run of ``size`` words within a row; a row with fewer words has one, of all its words."""
        h, counts = self.hashes, np.diff(self.bounds)
        rows = np.repeat(np.arange(len(counts)), counts)
        weights = splitmix(np.arange(size, dtype=np.uint64) + np.uint64(77))
        if len(h) >= size:
            out = np.zeros(len(h) - size + 1, np.uint64)
            for j in range(size):
                out += h[j : len(h) - size + 1 + j] * weights[j]
            at = np.flatnonzero(rows[: len(out)] == rows[size - 1 :])
            out = splitmix(out[at])
        else:
            out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            more = np.empty(len(short), np.uint64)
            with np.errstate(over="ignore"):
                for k, row in enumerate(short):
                    own = h[self.bounds[row] : self.bounds[row + 1]]
                    more[k] = (own * weights[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
            out, at = np.concatenate([out, splitmix(more)]), np.concatenate([at, self.bounds[short]])
        return out, rows[at], at


def grouped_counts(hashes: np.ndarray, groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, group, count) of each of n groups, in order of the groups and hashes."""
    order = np.argsort(hashes)
    own = groups[order]
    # radix sort where the groups' numbers are small
    order = order[np.argsort(own.astype(np.uint16) if n < 1 << 16 else own, kind="stable")]
    hashes, groups = hashes[order], groups[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (groups[1:] != groups[:-1])
    at = np.flatnonzero(first)
    return hashes[at], groups[at], np.diff(np.append(at, len(hashes)))


def grouped_sets(hashes: np.ndarray, groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each of n groups in one array, and their n + 1 bounds."""
    hashes, groups, _ = grouped_counts(hashes, groups, n)
    return hashes, np.searchsorted(groups, np.arange(n + 1))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row's index, and each row's sorted distinct shingle hashes in one array with bounds."""
    data, offsets = utf8(column)
    for i, j in pieces(offsets):
        hashes, rows, _ = Words(data, offsets[i : j + 1]).shingles(size)
        yield i, *grouped_sets(hashes, rows, j - i)


#: A key with more than about 1 / HOT of all rows is dealt over several tasks.
HOT = 1000


def hot_keys(counts: DataFrame, key: str, held: str) -> DataFrame:
    """(key, _parts) of the keys with more than 2 / HOT of all rows, so fewer than HOT of them; counts is a stored table with one row a key."""
    total = counts.agg(F.sum(held)).first()[0] or 0
    each = max(1, total // HOT)
    return counts.where(F.col(held) > 2 * each).select(key, F.ceil(F.col(held) / each).cast("int").alias("_parts"))


def hot_join(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame, spread: str, how: str = "left") -> DataFrame:
    """rows with the one row of facts of their key: hot keys and null ones are dealt over several tasks by the column ``spread``."""
    few = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(spread), F.when(F.col(key).isNull(), HOT).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")
    left = rows.join(few, key, "left").withColumn("_salt", salt).drop("_parts")
    right = facts.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
