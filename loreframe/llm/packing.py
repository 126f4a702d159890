"""Packing documents into sequences as a cutting-stock problem.

Texts are encoded once and stored. A document's whole multiples of the sequence's size are sequences of their own; what is
left of each document is an item. Items are counted by length in a histogram whose classes are as fine as ``PRECISION``
(lengths round up within an octave's 64 steps, so the histogram has a bounded number of classes at any size of the
corpus). The linear program over patterns, how many items of each class a sequence takes, is solved on the driver by column
generation: a knapsack over the dual prices finds patterns that improve it, until the bound of the last prices is near. Whole
numbers of each pattern are taken, and the few items left over are packed first-fit by decreasing length into patterns of
their own.

Items are ranked within their class (by buckets of ids, so that a class with a third of all items is dealt over many
tasks), and an item's rank gives its pattern, sequence and slot.

Rounding leaves a little room in sequences, and some histograms leave much. Room of at least ``LEAST_FILL`` tokens is filled
from the last sequences, those of the worst patterns: as many as it takes are dissolved into a stream of tokens which is cut
along the room of the others. What remains of the stream, less than a sequence, becomes sequences of a power of two.

A stage is lost and repeated without harm: ids, keys and slots come from stored tables. Only the histogram, the counts and
one row of totals reach the driver.

Cases: a null or empty text is its end id alone; rows without an id are packed like others; repeated rows are rows of
their own; a document longer than a sequence is cut at multiples of the size; an empty table has no pieces; extra
columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.llm import token_files
from loreframe.llm.shared import lean, pieces, stored, utf8

SIZE, PRECISION, LEAST_FILL = 4096, 6, 16
#: The knapsack's best value beyond 1 at which the program counts as solved, and most pivots.
NEAR, PIVOTS = 1e-3, 4000
#: Tokens of the stream that one task cuts.
SPAN = 1 << 18
ENCODED = "key long, doc_id long, n long, crc long, ids binary"


def _encode(path: str, end: int) -> Callable:
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, key = token_files.encoder(path), TaskContext.get().partitionId() << 40
        for whole in batches:
            texts = whole.column("text").cast(pa.large_string())
            _, offsets = utf8(texts)
            for i, j in pieces(offsets, token_files.BATCH_BYTES):
                ids, counts = encode(texts.slice(i, j - i))
                ids, counts = np.insert(ids, np.cumsum(counts), end).astype("<u4"), counts + 1
                ends = np.concatenate([[0], np.cumsum(counts)])
                own = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [pa.array(np.arange(key, key + j - i)), whole.column("doc_id").slice(i, j - i), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n", "crc", "ids"])
                key += j - i

    return run


def encoded(docs: DataFrame, tokenizer: str | None = None, end: int = token_files.END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of ENCODED: a key for each row, and its ids with the end id as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(lean(_encode(tokenizer or token_files.default_tokenizer(), end)), ENCODED), "packing-ids")


def length_class(length: Column) -> Column:
    """The length, rounded up to a step of 2**-PRECISION of its octave."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(length)) - (PRECISION + 1), F.lit(0))).cast("long")
    return (F.ceil(length / step) * step).cast("long")


class Knapsack:
    """The best patterns of a capacity for prices of the sizes, by dynamic programming."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity

    def patterns(self, prices: np.ndarray, most: int = 24) -> tuple[float, list[np.ndarray]]:
        """(the best value, the best patterns, each holding another class at least once)."""
        paid = np.flatnonzero(prices > 1e-12)
        sizes, own = self.sizes[paid], prices[paid]
        best, choice = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        fits = np.searchsorted(sizes, np.arange(self.capacity + 1), side="right")
        for c in range(1, self.capacity + 1):
            best[c] = best[c - 1]
            if k := fits[c]:
                values = best[c - sizes[:k]] + own[:k]
                j = values.argmax()
                if values[j] > best[c]:
                    best[c], choice[c] = values[j], j
        ways = own + best[self.capacity - sizes]
        out = []
        for first in np.argsort(-ways)[:most]:
            pattern, c = np.zeros(len(self.sizes)), self.capacity - sizes[first]
            pattern[paid[first]] += 1
            while c > 0:
                if choice[c] < 0:
                    c -= 1
                else:
                    pattern[paid[choice[c]]] += 1
                    c -= sizes[choice[c]]
            out.append(pattern)
        return float(best[self.capacity]), out


def greedy_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """First-fit patterns by decreasing size: each fills a sequence with the largest items left, and is used until one of its classes is used up."""
    left, out = demand.copy(), []
    while (held := np.flatnonzero(left > 0)).size:
        room, pattern = capacity, np.zeros(len(sizes))
        for j in held[::-1]:
            if sizes[j] <= room:
                pattern[j] = max(1, min(room // sizes[j], int(left[j])))
                room -= int(pattern[j]) * sizes[j]
        held = np.flatnonzero(pattern)
        ratio = left[held] / pattern[held]
        left -= ratio.min() * pattern
        left[held[ratio.argmin()]] = 0
        out.append(pattern)
    return np.array(out)


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, near: float = NEAR, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns, how often each, a lower bound of the number of sequences) of the linear program, sizes rising.

    The basis begins with the patterns of one class each, and first-fit patterns are offered before the knapsack's. A
    pattern enters while its items are worth more than a sequence
    at the basis's prices; ``value`` times fewer sequences than the basis takes can't do.
    """
    m = len(sizes)
    demand = demand * (1 + 1e-7 * np.random.default_rng(1).random(m))  # ties make steps of no length
    single = (capacity // sizes).astype(float)
    basis, inverse, x, bound, done = np.diag(single), np.diag(1 / single), demand / single, 0.0, 0
    knapsack, table = Knapsack(sizes, capacity), greedy_patterns(sizes, demand, capacity)
    while True:
        while done < pivots:
            worth = table @ inverse.sum(axis=0)
            k = int(worth.argmax())
            if worth[k] <= 1 + near / 2:
                break
            step = inverse @ table[k]
            ratio = np.full(m, np.inf)
            np.divide(x, step, out=ratio, where=step > 1e-7)
            i = int(ratio.argmin())
            x = x - ratio[i] * step
            x[i] = ratio[i]
            row = inverse[i] / step[i]
            inverse = inverse - np.outer(step, row)
            inverse[i] = row
            basis[:, i] = table[k]
            done += 1
            if done % 200 == 0:
                inverse = np.linalg.inv(basis)
                x = np.maximum(inverse @ demand, 0)
        value, offered = knapsack.patterns(inverse.sum(axis=0))
        bound = max(bound, x.sum() / max(value, 1.0))
        if value <= 1 + near or done >= pivots:
            break
        table = np.concatenate([table[-4 * m :], np.array(offered)])
    return basis.T.astype(np.int64), np.maximum(x, 0), bound


def first_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns of the items left over, by decreasing length into the fullest sequence with room."""
    room, out = np.zeros(0, np.int64), []
    for j in np.argsort(-sizes):
        left = int(counts[j])
        while left:
            fits = np.flatnonzero(room >= sizes[j])
            if len(fits):
                at = int(fits[room[fits].argmin()])
            else:
                room, at = np.append(room, capacity), len(room)
                out.append(np.zeros(len(sizes), np.int64))
            take = min(left, int(room[at] // sizes[j]))
            out[at][j] += take
            room[at] -= take * sizes[j]
            left -= take
    return out


def plan(histogram: dict[int, int], capacity: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {class: items of it in each}) of all items, fullest patterns first."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    patterns, often, _ = column_generation(sizes, demand.astype(float), capacity)
    times = np.floor(often + 1e-6).astype(np.int64)
    left, chosen = demand.copy(), []
    for pattern, n in sorted(zip(patterns, times.tolist(), strict=True), key=lambda p: -int(p[0] @ sizes)):
        # the perturbed demand may ask for one item more than there is
        n = min([n, *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if n > 0:
            chosen.append((int(n), pattern))
            left -= n * pattern
    chosen += [(1, p) for p in first_fit(sizes, left, capacity)]
    chosen.sort(key=lambda p: -int(p[1] @ sizes))
    return [(n, {int(s): int(k) for s, k in zip(sizes, p, strict=True) if k}) for n, p in chosen]


def slots(planned: list[tuple[int, dict[int, int]]], first: int) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """(class, [(first rank, end rank, first sequence, items a sequence)]) of a plan whose sequences are numbered from first."""
    out: dict[int, list] = {}
    for n, pattern in planned:
        for size, k in pattern.items():
            own = out.setdefault(size, [])
            begin = own[-1][1] if own else 0
            own.append((begin, begin + n * k, first, k))
        first += n
    return sorted(out.items())


def _ranked(items: DataFrame, count: int) -> DataFrame:
    """items with rank: their place within their class, from 0. Buckets of a class are counted first, then each bucket is numbered."""
    buckets = max(1, int(count**0.5))
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("class", "bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(sizes.select("class", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "packing-buckets")
    own = W.partitionBy("class", "bucket").orderBy("doc_id", "crc", "n", "start", "key")
    return dealt.join(starts, ["class", "bucket"]).withColumn("rank", F.col("_before") + F.row_number().over(own) - 1).drop("_before", "bucket")


def _filled(packed: DataFrame, size: int, least: int) -> DataFrame:
    """packed (key, start, length, sequence_id, offset, total) with the room of its sequences filled from the last ones."""
    spark, names = packed.sparkSession, ["key", "start", "length", "sequence_id", "offset"]
    room = size - F.col("total")
    # a power of two isn't padded
    room = F.when((room >= least) & (F.col("total").bitwiseAND(F.col("total") - 1) != 0), room).otherwise(F.lit(0))
    each = packed.where("offset = 0").select("sequence_id", "total", room.alias("room"))
    n = each.count()
    if not n:
        return packed.select(*names)
    run = max(1, int(n**0.5))
    each = each.withColumn("run", F.floor(F.col("sequence_id") / run))
    before = lambda *keys: (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("run" if not keys else "sequence_id").rowsBetween(W.unboundedPreceding, -1)
    sums = each.groupBy("run").agg(F.sum("total").alias("_total"), F.sum("room").alias("_room"))
    sums = sums.select("run", *[F.coalesce(F.sum(c).over(before()), F.lit(0)).alias(c) for c in ("_total", "_room")])
    placed = each.join(sums, "run").select("sequence_id", "total", "room", *[(F.col(f"_{c}") + F.coalesce(F.sum(c).over(before("run")), F.lit(0))).alias(f"{c}_before") for c in ("total", "room")])
    placed = stored(placed, "packing-room")
    tokens = placed.agg(F.sum("total")).first()[0]
    # the last sequence from which on there are tokens enough for the room before it
    cut = placed.where(F.lit(tokens) - F.col("total_before") >= F.col("room_before")).orderBy(F.desc("sequence_id")).first()
    last, filled, rest = cut.sequence_id, cut.room_before, tokens - cut.total_before - cut.room_before
    rooms = placed.where((F.col("sequence_id") < last) & (F.col("room") > 0)).select(F.col("room_before").alias("at"), F.col("room").alias("width"), F.struct("sequence_id", F.col("total").alias("offset"), F.col("room_before").alias("at")).alias("room"))
    ends = [1 << k for k in range(size.bit_length()) if rest >> k & 1]
    new = [(filled + sum(ends[k + 1 :]), width, (last + k, 0, filled + sum(ends[k + 1 :]))) for k, width in enumerate(ends)]
    rooms = rooms.unionByName(spark.createDataFrame(new, rooms.schema))
    stream = packed.where(F.col("sequence_id") >= last).join(placed.where(F.col("sequence_id") >= last).select("sequence_id", "total_before"), "sequence_id")
    at = F.col("total_before") - cut.total_before + F.col("offset")
    stream = stream.select(at.alias("at"), F.col("length").alias("width"), F.struct("key", "start", at.alias("at")).alias("piece"))
    both = stream.withColumn("room", F.lit(None).cast(rooms.schema["room"].dataType)).unionByName(rooms.withColumn("piece", F.lit(None).cast(stream.schema["piece"].dataType)))
    # a piece or room that crosses spans is told to each; equal places are one event
    both = both.withColumn("span", F.explode(F.sequence(F.floor(F.col("at") / SPAN), F.floor((F.col("at") + F.col("width") - 1) / SPAN))))
    events = both.groupBy("span", F.greatest("at", F.col("span") * SPAN).alias("at")).agg(F.max("piece").alias("piece"), F.max("room").alias("room"))
    order = W.partitionBy("span").orderBy("at")
    end = F.coalesce(F.lead("at").over(order), F.least((F.col("span") + 1) * SPAN, F.lit(filled + rest)))
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = events.select("at", end.alias("end"), F.last("piece", ignorenulls=True).over(so_far).alias("piece"), F.last("room", ignorenulls=True).over(so_far).alias("room"))
    cuts = parts.select("piece.key", (F.col("piece.start") + F.col("at") - F.col("piece.at")).alias("start"), (F.col("end") - F.col("at")).alias("length"), "room.sequence_id", (F.col("room.offset") + F.col("at") - F.col("room.at")).alias("offset"))
    return packed.where(F.col("sequence_id") < last).select(*names).unionByName(cuts)


def packed(ids: DataFrame, size: int = SIZE, least: int = LEAST_FILL) -> DataFrame:
    """(key, start, length, sequence_id, offset) of every piece of the stored table ``ids``; pieces of a sequence follow each other without room."""
    docs = ids.select("key", "doc_id", "n", "crc")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / size) - 1, F.lit(0)))
    items = docs.withColumn("start", F.explode(starts)).withColumn("start", F.col("start") * size).withColumn("length", F.least(F.lit(size), F.col("n") - F.col("start")).cast("long"))
    items = items.withColumn("class", length_class(F.col("length")))
    items = items.withColumn("class", F.when(F.col("length") == size, F.lit(size + 1)).otherwise(F.col("class"))).select("key", "doc_id", "crc", "n", "start", "length", "class")
    histogram = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(size + 1, 0)
    known = slots([(full, {size + 1: 1})] * bool(full) + plan(histogram, size), 0)
    table = items.sparkSession.createDataFrame(known, "class long, slots array<struct<begin:long,end:long,first:long,each:long>>")
    ranked = _ranked(items, full + sum(histogram.values())).join(F.broadcast(table), "class")  # one row a class of lengths
    own = F.filter("slots", lambda s: (s["begin"] <= F.col("rank")) & (F.col("rank") < s["end"]))[0]
    placed = ranked.withColumn("_own", own).withColumn("sequence_id", F.col("_own.first") + F.floor((F.col("rank") - F.col("_own.begin")) / F.col("_own.each")))
    inside = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("length").over(W.partitionBy("sequence_id"))
    out = stored(placed.select("key", "start", "length", "sequence_id", offset.alias("offset"), total.alias("total")), "packing-slots")
    mixed = out.where(F.col("sequence_id") >= full)
    return out.where(F.col("sequence_id") < full).drop("total").unionByName(_filled(mixed, size, least))


def with_ids(ids: DataFrame, pieces_: DataFrame, of: Callable[[Column], Column] = lambda part: part.alias("ids")) -> DataFrame:
    """pieces with doc_id, doc_tokens and what ``of`` makes of their ids (binary); documents meet the list of their pieces, so ids are shuffled once."""
    lists = pieces_.groupBy("key").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    part = lambda p: F.substring("ids", (4 * p["start"] + 1).cast("int"), (4 * p["length"]).cast("int"))
    told = F.transform("pieces", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset"), of(part(p)).alias("told")))
    each = ids.join(lists, "key").select("doc_id", F.col("n").alias("doc_tokens"), F.explode(told).alias("p"))
    return each.select("doc_id", "p.start", "p.length", "p.told", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces_: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order, from with_ids(...) whose column told holds ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "told"))), lambda p: p["told"])
    return pieces_.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def pack(docs: DataFrame, size: int = SIZE, least: int = LEAST_FILL, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ids, pieces): the stored ids of docs, and where their pieces lie; see with_ids and sequences."""
    ids = encoded(docs, tokenizer, id_col=id_col, text_col=text_col)
    return ids, packed(ids, size, least)
