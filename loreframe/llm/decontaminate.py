"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased (A-Z) runs without ASCII white space. An item of w words is compared with every window of
w words of a document (a shorter document is one window). Items and windows get 256-bit SimHash fingerprints of
their 5-word shingles, each weighted by its count. Fingerprints are split into 16 blocks of 16 bits; two within
``RADIUS`` = 63 bits differ by at most 3 bits in at least one block, so looking up each block within 3 bits finds
every item of the size within the radius. What is found within the radius is verified by the exact weighted
Jaccard similarity (sum of minima over sum of maxima of the counts), ``percent`` or more. At a similarity of 0.75
fingerprints differ by 44 bits on average with a standard deviation of 6, so that fewer than one in a thousand true
matches at the very threshold is missed; random windows differ by 128.

An exact bound decides which windows are fingerprinted: those where enough positions hold shingles of items of
the size; all others have a lower similarity. An item of fewer than 5 words has one shingle, of its own length, and
matches where a window of as many words has it. Items are a query set: they are sent to the tasks in blocks of at most
``ITEMS`` items and ``ITEM_WORDS`` words, so that documents are scanned once for all but very large sets, and nothing is
shuffled but the pairs found. Tables of the values near the items' own answer a window by one search a block; they are kept up to
``TABLE_BYTES``, and items beyond are looked up by all values near the window's, which needs no room and finds the same.

Cases: null and empty texts and items match nothing; items with equal words match alike; fewer words than a
shingle make one shingle; repeated rows of documents give repeated pairs once each by id; empty tables give no
pairs; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.llm.shared import Words, lean, n_words, pieces, splitmix, stored, utf8

PERCENT, SHINGLE, RADIUS = 75, 5, 63
LANES, BLOCKS, ITEMS, ITEM_WORDS = 4, 16, 50_000, 8_000_000
#: Bytes of tables that hold all values near the items' own; items beyond are found by the values near a window's.
TABLE_BYTES = 96 << 20
#: Positions that are fingerprinted at a time.
SPAN = 8192
PAIRS = "doc_id long, item_id long, similarity double, hamming int, first_word int, n_words int"


def _bits(hashes: np.ndarray) -> np.ndarray:
    """n x (64 * LANES) bits of the hashes."""
    lanes = np.stack([splitmix(hashes ^ splitmix(np.uint64(k + 1))) for k in range(LANES)], axis=1)
    return np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1)


def _running(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set before each place, and in all."""
    out = np.zeros((len(hashes) + 1, 64 * LANES), np.int32)
    np.cumsum(_bits(hashes), axis=0, dtype=np.int32, out=out[1:])
    return out


def fingerprints(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """n x LANES: the SimHash of each run hashes[begin:end], begins and ends rising: a bit is set where more hashes have it than not."""
    out = np.zeros((len(begins), LANES), np.uint64)
    i = 0
    while i < len(begins):
        j = int(min(np.searchsorted(begins, begins[i] + SPAN, side="right"), np.searchsorted(ends, ends[i] + SPAN, side="right")))
        # the first run's counts, and what later runs lose at their beginning and gain at their end
        sums = np.zeros(64 * LANES, np.int32)
        for k in range(int(begins[i]), int(ends[i]), SPAN):
            sums += _bits(hashes[k : min(k + SPAN, ends[i])]).sum(axis=0, dtype=np.int32)
        gained, lost = _running(hashes[ends[i] : ends[j - 1]]), _running(hashes[begins[i] : begins[j - 1]])
        sums = sums + gained[ends[i:j] - ends[i]] - lost[begins[i:j] - begins[i]]
        out[i:j] = np.packbits(2 * sums > (ends[i:j] - begins[i:j])[:, None], axis=1).view(np.uint64)
        i = j
    return out


def near_masks(radius: int) -> np.ndarray:
    """All 16-bit values of at most radius bits."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) <= radius]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Index:
    """Items by number of words, and in these by the blocks of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int, radius: int):
        self.shingle, self.radius = shingle, radius
        words = Words(*utf8(pa.array(texts, pa.string())))
        self.ids, self.sizes = np.array(ids, np.int64), np.diff(words.bounds)
        hashes, rows, _ = words.shingles(shingle)
        # items of fewer words than a shingle: by size, their one shingle
        self.short: dict[int, dict[int, list[int]]] = {}
        for size in np.unique(self.sizes[(self.sizes > 0) & (self.sizes < shingle)]).tolist():
            own, of, _ = words.shingles(size)
            held = self.short.setdefault(size, {})
            for h, i in zip(own.tolist(), of.tolist(), strict=True):
                if self.sizes[i] == size:
                    held.setdefault(h, []).append(i)
        keep = self.sizes[rows] >= shingle
        hashes, rows = hashes[keep], rows[keep]
        order = np.argsort(rows, kind="stable")
        hashes, cuts = hashes[order], np.searchsorted(rows[order], np.arange(len(ids) + 1))
        self.own = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.prints = fingerprints(hashes, cuts[:-1], cuts[1:])
        self.known = np.unique(hashes)
        # the sizes of the items that have each known shingle
        holders = np.unique(np.stack([np.searchsorted(self.known, hashes), np.repeat(self.sizes, np.diff(cuts))]), axis=1)
        self.holder_cuts, self.holder_sizes = np.searchsorted(holders[0], np.arange(len(self.known) + 1)), holders[1]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.known >> np.uint64(44)] = True
        self.sized: dict[int, tuple[np.ndarray, list[np.ndarray] | None]] = {}
        self.own_values: dict[int, list[np.ndarray]] = {}
        self.room = TABLE_BYTES

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are shingles of items."""
        out = self.seen[hashes >> np.uint64(44)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
            out[at] = self.known[place] == hashes[at]
        return out

    def sizes_of(self, hashes: np.ndarray) -> list[int]:
        """The sizes of the items that have any of these known shingles; items of other sizes can't be similar."""
        at = np.searchsorted(self.known, np.unique(hashes))
        found = [self.holder_sizes[self.holder_cuts[k] : self.holder_cuts[k + 1]] for k in at]
        return np.unique(np.concatenate(found)).tolist()

    def tables(self, size: int) -> tuple[np.ndarray, list[np.ndarray] | None]:
        """The items of a size, and for each block the sorted (value << 16 | item's place) of all values near the items' own; None where there is no room."""
        if size not in self.sized:
            of = np.flatnonzero(self.sizes == size)
            values, masks, near = self.prints[of].view("<u2"), near_masks(self.radius // BLOCKS), None
            bytes_ = len(of) * len(masks) * BLOCKS * 4
            if len(of) < 1 << 16 and bytes_ <= self.room:
                self.room -= bytes_
                near = [np.sort(((values[:, b, None] ^ masks).astype(np.uint32) << np.uint32(16) | np.arange(len(of), dtype=np.uint32)[:, None]).ravel()) for b in range(BLOCKS)]
            self.sized[size] = of, near
        return self.sized[size]

    def values(self, size: int) -> list[np.ndarray]:
        """For each block the sorted (value << 32 | item's place) of the items of a size."""
        if size not in self.own_values:
            of = self.tables(size)[0]
            values, places = self.prints[of].view("<u2").astype(np.uint64), np.arange(len(of), dtype=np.uint64)
            self.own_values[size] = [np.sort(values[:, b] << np.uint64(32) | places) for b in range(BLOCKS)]
        return self.own_values[size]

    @staticmethod
    def _met(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which search, where in the table) of every entry from low to high of each search."""
        begin = np.searchsorted(table, low)
        counts = np.searchsorted(table, high, side="right") - begin
        return np.repeat(np.arange(len(low)), counts), np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    def within(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of items of a size within the radius of the windows' fingerprints."""
        of, near = self.tables(size)
        own = self.values(size) if near is None else []
        values, found = np.ascontiguousarray(prints).view("<u2"), []
        for b in range(BLOCKS):
            if near is not None:
                at = values[:, b].astype(np.uint32) << np.uint32(16)
                windows, place = self._met(near[b], at, at | np.uint32(0xFFFF))
                found.append(windows << 32 | (near[b][place] & np.uint32(0xFFFF)).astype(np.int64))
                continue
            masks = near_masks(self.radius // BLOCKS)
            for i in range(0, len(prints), 256):
                at = (values[i : i + 256, b, None] ^ masks).ravel().astype(np.uint64) << np.uint64(32)
                search, place = self._met(own[b], at, at | np.uint64(0xFFFFFFFF))
                found.append((i + search // len(masks)) << 32 | (own[b][place] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        windows, items = pairs >> 32, of[pairs & 0xFFFFFFFF]
        keep = distances(prints[windows], self.prints[items]) <= self.radius
        return windows[keep], items[keep]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the counts: a as (sorted values, counts), b as plain values."""
    values, counts = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(a[0], values, assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], counts[j]).sum())
    return least / (int(a[1].sum()) + len(b) - least)


def matches(index: Index, hashes: np.ndarray, n_words: int, percent: int) -> Iterator[tuple[int, float, int, int, int]]:
    """(item, similarity, hamming, first word, words) of one document's best window for each item; hashes are its shingles in order."""
    hit = np.flatnonzero(index.hits(hashes))
    if not len(hit):
        return
    best: dict[int, tuple] = {}
    for size in index.sizes_of(hashes[hit]):
        width = max(1, size - index.shingle + 1)
        last = max(0, len(hashes) - width)
        # a window that starts at s holds the shingles s .. s + width - 1
        near = np.zeros(last + 2, np.int32)
        np.add.at(near, np.clip(hit - width + 1, 0, last), 1)
        np.add.at(near, np.minimum(hit, last) + 1, -1)
        held = np.cumsum(near[:-1])
        # fewer shared shingles than the similarity needs can't pass: held counts positions, so it bounds the overlap
        begins = np.flatnonzero(100 * held >= percent * min(width, len(hashes)))
        if not len(begins):
            continue
        ends = np.minimum(begins + width, len(hashes))
        prints = fingerprints(hashes, begins, ends)
        for w, i in zip(*index.within(size, prints), strict=True):
            a, b = int(begins[w]), int(ends[w])
            similarity = weighted_jaccard(index.own[i], hashes[a:b])
            if 100 * similarity >= percent:
                found = (similarity, -a, int(distances(prints[w], index.prints[i])), min(size, n_words))
                if i not in best or found[:2] > best[i][:2]:
                    best[i] = found
    for i, (similarity, a, distance, size) in sorted(best.items()):
        yield int(index.ids[i]), similarity, distance, -a, size


def _scan(ids: list[int], texts: list[str], percent: int, shingle: int, radius: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(ids, texts, shingle, radius)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            docs, out = batch.column("id").to_pylist(), []
            for i, j in pieces(offsets):
                words = Words(data, offsets[i : j + 1])
                hashes, rows, at = words.shingles(shingle)
                hit = np.unique(rows[index.hits(hashes)]) if len(hashes) else []
                for row in hit:
                    own = np.flatnonzero(rows == row)
                    own = own[np.argsort(at[own])]
                    count = int(words.bounds[row + 1] - words.bounds[row])
                    out += [(docs[i + row], *found) for found in matches(index, hashes[own], count, percent)]
                for size, held in index.short.items():
                    own, of, at = words.shingles(size)
                    met = np.flatnonzero(np.isin(own, np.array(list(held), np.uint64)))
                    first: dict[tuple[int, int], int] = {}
                    for k in met[np.argsort(at[met])].tolist():
                        for item in held[int(own[k])]:
                            first.setdefault((int(of[k]), item), int(at[k] - words.bounds[of[k]]))
                    out += [(docs[i + row], int(index.ids[item]), 1.0, 0, place, size) for (row, item), place in first.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PAIRS.split(", ")])

    return go


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text, block) of the items, in blocks of bounded size, and how many blocks there are."""
    sized = stored(items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("words", n_words("text")), "items")
    count, words = sized.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    n = max(1, -(-2 * count // ITEMS), -(-2 * words // ITEM_WORDS)) if count > ITEMS or words > ITEM_WORDS else 1
    return sized.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, hamming, first_word, n_words): the best window for each pair, once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out, (sized, n) = docs.sparkSession.createDataFrame([], PAIRS), item_blocks(items, item_id, item_text)
    for k in range(n):
        own = sized.where(F.col("block") == k).orderBy("id", "text").collect()
        if own:
            part = rows.mapInArrow(lean(_scan([r.id for r in own], [r.text for r in own], percent, shingle, radius)), PAIRS)
            # of several blocks each is done before the next is brought to the driver
            out = out.union(part if n == 1 else stored(part, "contaminated-block"))
    best = W.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "first_word")
    return out.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def without(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is in no pair found; for ids that name one text each. See ``clean``."""
    gone = stored(found.select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(gone, id_col, "left_anti")


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, radius: int = RADIUS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text holds no item. Rows are known by a digest of their text: equal texts are judged alike, whatever their ids, and rows without an id like others."""
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.lit(3), text_col).alias("_key"), F.col(text_col).alias("_text"))
    found = contaminated(keyed, items, percent, shingle, radius, "_key", "_text", item_id, item_text)
    gone = stored(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return keyed.join(gone, "_key", "left_anti").select("_row.*")
