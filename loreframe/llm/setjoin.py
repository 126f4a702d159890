"""Exact set-similarity join of token sets on Spark.

Equal sets are one class. Tokens are ordered by rarity over all classes, so that the sets that can't be
linked are known by counting: a link needs ``percent`` of a set's tokens in the other set, and a token that
one class alone holds is in no other. Steps:

1. ``members``: each entity's class and size. The same pass counts very common tokens (those in more than
   ``HEAVY_SHARE`` of the classes of some run of rows); at most ``HEAVY_MOST`` of them are broadcast. They go
   last in the order and need no counting.
2. ``survivors``: all other tokens are dealt by range of their hash as packed arrays, one row a range and
   run; a range is counted by sorting; what at least two hold goes back to its run. Class ids are dealt likewise, so
   that of the runs that have a class one goes on with it. Sets with too few shared tokens end here; the others go
   on with their shared tokens in the order (rarest first).
3. ``blocks``: sets that share a prefix token are tied to the token's smallest class (a star, not pairs);
   the components of these ties are blocks. No link leaves a block.
4. Each block is joined in a prefix tree (``trie``), in chunks of at most about ``CHUNK`` sets. A block of
   more chunks joins its components' first sets, then all sets that lie outside its largest component
   against all sets of the block, chunk by chunk; a component is never joined with itself.

Class ids are 128-bit hashes of whole sets, since equal ids are one class over all of the input. Token hashes have 64
bits where sets are made; 56 of them are dealt, and a collision would have to fall within a compared pair to matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreframe.llm import trie
from loreframe.llm.components import components
from loreframe.llm.shared import hot_join, hot_keys, lean, splitmix, stored
from loreframe.llm.trie import KEY

RUN_TOKENS = 1_000_000
HEAVY_SHARE = 1 / 500
HEAVY_MOST = 200_000
RANGE_TOKENS = 500_000
#: Tokens that a row of a run and a range should hold, and most tokens of a run and of a range (some 50 bytes of memory each).
ROW_TOKENS, MOST_TOKENS = 100, 16_000_000
CHUNK = 1024
#: Classes that a task remembers to have dealt; one that is forgotten is dealt again.
REMEMBERED = 300_000
_HEAVY_ORDER = 1 << 31
_DROPPED = np.uint64(8)
_LANES = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

#: Entities of a batch: (entity columns as arrays, sorted distinct token hashes of all in one array, their bounds).
Sets = Callable[[pa.RecordBatch], Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]]


def class_ids(tokens: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """n x 2 lanes of 64 bits: equal for equal sets, whose distinct tokens lie between the cuts."""
    lanes = []
    for seed in _LANES:
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(splitmix(tokens ^ seed), out=total[1:])
        lanes.append(splitmix(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64)))
    return np.stack(lanes, axis=1)


def as_keys(lanes: np.ndarray, empty: np.ndarray | None = None) -> pa.Array:
    """Class ids as 16-byte binary values, null where a set is empty."""
    n = len(lanes)
    offsets = pa.py_buffer((np.arange(n + 1) * 16).astype(np.int32).tobytes())
    valid = None if empty is None else pa.py_buffer(np.packbits(~empty, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [valid, offsets, pa.py_buffer(np.ascontiguousarray(lanes).tobytes())])


def run_id(number: int, content: np.ndarray) -> int:
    """Id of a task's run: equal content of two runs has two ids, a retried task's runs have the same. A retry with other rows gives other ids, not mixed runs."""
    task = TaskContext.get()
    content = np.concatenate([np.array([task.partitionId() if task else 0, number], np.uint64), content])
    return int.from_bytes(hashlib.blake2b(content.tobytes(), digest_size=8).digest(), "little", signed=True)


class _Fresh:
    """The sets of a task that are neither empty nor dealt before."""

    def __init__(self):
        self.known: set[bytes] = set()

    def __call__(self, tokens: np.ndarray, cuts: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, sizes, lanes) of those."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        sizes, raw = np.diff(cuts), lanes.tobytes()
        keep = np.zeros(len(sizes), bool)
        for i in np.flatnonzero(sizes).tolist():
            own = raw[16 * i : 16 * i + 16]
            if own not in self.known:
                self.known.add(own)
                keep[i] = True
        return tokens[np.repeat(keep, sizes)], sizes[keep], lanes[keep]


def _members(sets: Sets, names: list[str]) -> Callable:
    columns = [*names, "n", "cls", "token", "held"]

    def heavy(held: list[np.ndarray], seen: int) -> pa.RecordBatch | None:
        tokens = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(first, len(tokens)))
        keep = counts >= max(2, HEAVY_SHARE * seen)
        if not keep.any():
            return None
        n = int(keep.sum())
        none = [*[pa.nulls(n, pa.int64())] * (len(names) + 1), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(tokens[first[keep]].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, fresh = [], 0, 0, _Fresh()
        for batch in batches:
            for own, tokens, cuts in sets(batch):
                sizes, lanes = np.diff(cuts), class_ids(tokens, cuts)
                none = pa.nulls(len(sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in own], pa.array(sizes.astype(np.int64)), as_keys(lanes, sizes == 0), none, none], names=columns)
                tokens, sizes, _ = fresh(tokens, cuts, lanes)
                held.append(tokens)
                size, seen = size + len(tokens), seen + len(sizes)
                if size >= RUN_TOKENS:
                    if (out := heavy(held, seen)) is not None:
                        yield out
                    held, size, seen = [], 0, 0
        if size and (out := heavy(held, seen)) is not None:
            yield out

    return run


def members(rows: DataFrame, sets: Sets, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entities with n and cls, null for an empty set; counts of common tokens), written to the shared folder."""
    schema = ", ".join([*(f"{c} long" for c in [*names, "n"]), "cls binary", "token long", "held long"])
    out = stored(rows.mapInArrow(lean(_members(sets, names)), schema), "members")
    return out.where("token is null").select(*names, "n", "cls"), out.where("token is not null").select("token", "held")


def _heavy(counts: DataFrame, classes: int) -> np.ndarray:
    """The commonest tokens, rarest first: at most the mean size of a set over HEAVY_SHARE, and HEAVY_MOST at most."""
    found = counts.groupBy("token").agg(F.sum("held").alias("held")).where(F.col("held") >= max(2, HEAVY_SHARE * classes))
    found = found.orderBy(F.desc("held"), "token").limit(HEAVY_MOST).toPandas().sort_values(["held", "token"])
    return found["token"].to_numpy(np.int64).view(np.uint64)


#: A range's tokens with their rows in the run, and its class ids with theirs (own); a run's class ids, sizes and common tokens.
_POSTED = "range int, run long, tokens binary, rows binary, own binary, classes binary, sizes binary, heavy binary"


def sizes_for(tokens: int) -> tuple[int, int]:
    """(tokens of a run, ranges) for so many tokens in all: runs and ranges grow with the root of the corpus, so that the rows
    between them stay large; from some 10 billion tokens on they need more memory, up to MOST_TOKENS."""
    grown = min(MOST_TOKENS, int((ROW_TOKENS * tokens) ** 0.5))
    return max(RUN_TOKENS, grown), min(1 << 20, max(64, tokens // max(RANGE_TOKENS, grown)))


def _post(sets: Sets, ranges: int, common: np.ndarray, most: int) -> Callable:
    """Runs of classes: one row for each range of token hashes, and one (range -1) with the run's classes."""

    by_value = np.argsort(common)
    sorted_common = common[by_value]
    maybe = np.zeros(1 << 20, bool)
    maybe[common >> np.uint64(44)] = True

    def flush(number: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, sizes, lanes = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        is_common, heavy = np.zeros(len(tokens), bool), np.zeros((2, 0), np.uint32)
        if len(common):
            look = np.flatnonzero(maybe[tokens >> np.uint64(44)])
            at = np.minimum(np.searchsorted(sorted_common, tokens[look]), len(common) - 1)
            met = sorted_common[at] == tokens[look]
            is_common[look] = met
            heavy = np.stack([rows[look[met]], by_value[at[met]].astype(np.uint32)])
        tokens, rows = tokens[~is_common], rows[~is_common]
        order = np.argsort(tokens)
        tokens, rows = tokens[order], rows[order]
        run = run_id(number, lanes.ravel())
        range_of = lambda x: ((x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        dealt, by_id = range_of(tokens), np.argsort(lanes[:, 0])
        dealt_ids = range_of(lanes[by_id, 0])
        rows_out = []
        for k in np.union1d(dealt, dealt_ids).tolist():
            a, b = np.searchsorted(dealt, [k, k + 1])
            own = by_id[slice(*np.searchsorted(dealt_ids, [k, k + 1]))]
            rows_out.append((k, run, squeeze(_rising(tokens[a:b] >> _DROPPED)), squeeze(_planes(rows[a:b])), squeeze(lanes[own].tobytes() + _planes(own)), None, None, None))
        rows_out.append((-1, run, None, None, None, lanes.tobytes(), sizes.astype("<u4").tobytes(), np.ascontiguousarray(heavy).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_out, strict=True), _POSTED_TYPES, strict=True)], names=_POSTED_NAMES)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, fresh = [], 0, 0, _Fresh()
        for batch in batches:
            for _, tokens, cuts in sets(batch):
                held.append(fresh(tokens, cuts, class_ids(tokens, cuts)))
                size += len(held[-1][0])
                if size >= most:
                    yield from flush(number, held)
                    held, size, number = [], 0, number + 1
        if size:
            yield from flush(number, held)

    return go


_POSTED_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
_POSTED_NAMES = [x.split()[0] for x in _POSTED.split(", ")]


def _planes(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Values as planes of their bytes: planes that are the same throughout cost nothing once compressed."""
    x = np.ascontiguousarray(x.astype(kind))
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplaned(x: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze(x: bytes) -> bytes:
    """x by zstd behind its length: planes of small values take few bits."""
    return len(x).to_bytes(4, "little") + pa.compress(x, codec="zstd", asbytes=True)


def unsqueeze(x: bytes) -> bytes:
    return pa.decompress(x[4:], int.from_bytes(x[:4], "little"), codec="zstd", asbytes=True)


def _rising(x: np.ndarray) -> bytes:
    """Rising uint64 values as planes of their differences."""
    return _planes(np.diff(x, prepend=np.uint64(0)), "<u8")


def _risen(x: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(x, "<u8"), dtype=np.uint64)


def pack(keys: np.ndarray, rising: bool = False) -> bytes:
    """KEY values as planes; tokens that rise are kept as differences."""
    token = np.ascontiguousarray(keys["token"])
    return squeeze(_planes(keys["order"]) + (_rising(token) if rising else _planes(token, "<u8")))


def unpack(x: bytes, rising: bool = False) -> np.ndarray:
    x = unsqueeze(x)
    n = len(x) // 12
    out = np.empty(n, KEY)
    out["order"], out["token"] = _unplaned(x[: 4 * n]), _risen(x[4 * n :]) if rising else _unplaned(x[4 * n :], "<u8")
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        each = list(zip(*columns, strict=True))
        begin = 0
        for i, key in enumerate(each):
            if key != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, key
        if len(each) > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _owned(parts: list[bytes], runs: list[int]) -> list[np.ndarray]:
    """For each run's class ids with their rows, the rows of those that no run of a lower id has."""
    raw = [unsqueeze(x) for x in parts]
    lanes = np.concatenate([np.frombuffer(x[: len(x) // 20 * 16], np.uint64).reshape(-1, 2) for x in raw])
    rows = np.concatenate([_unplaned(x[len(x) // 20 * 16 :]) for x in raw])
    source = np.repeat(np.arange(len(runs)), [len(x) // 20 for x in raw])
    order = np.lexsort((np.array(runs, np.int64)[source], lanes[:, 1], lanes[:, 0]))
    lanes, rows, source = lanes[order], rows[order], source[order]
    first = np.ones(len(rows), bool)
    first[1:] = (lanes[1:] != lanes[:-1]).any(axis=1)
    rows, source = rows[first], source[first]
    order = np.argsort(source, kind="stable")
    return np.split(rows[order], np.searchsorted(source[order], np.arange(1, len(runs))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges -> what each run holds of tokens that at least two classes hold: (order, token) and the class's row in its run; and the rows of the classes it goes on with."""
    for part in grouped(batches, ["range"]):
        if part.column("range")[0].as_py() < 0:
            for batch in part.to_batches():
                yield batch.select(_POSTED_NAMES[1:])
            continue
        runs = part.column("run").to_pylist()
        tokens = [_risen(unsqueeze(x)) for x in part.column("tokens").to_pylist()]
        rows = np.concatenate([_unplaned(unsqueeze(x)) for x in part.column("rows").to_pylist()])
        source = np.repeat(np.arange(len(runs)), [len(x) for x in tokens])
        every = np.concatenate(tokens)
        order = np.argsort(every)
        every, rows, source = every[order], rows[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(every)))
        held = np.repeat(counts, counts)
        keep = held >= 2
        every, rows, source, held = every[keep], rows[keep], source[keep], np.minimum(held[keep], _HEAVY_ORDER - 1)
        order = np.argsort(source, kind="stable")
        cuts = np.searchsorted(source[order], np.arange(len(runs) + 1))
        out = []
        for k, (run, owned) in enumerate(zip(runs, _owned(part.column("own").to_pylist(), runs), strict=True)):
            own = order[cuts[k] : cuts[k + 1]]
            packed = np.empty(len(own), KEY)
            packed["order"], packed["token"] = held[own], every[own]
            out.append((run, pack(packed, rising=True), squeeze(_planes(rows[own])), owned.astype("<u4").tobytes(), None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _POSTED_TYPES[1:], strict=True)], names=_POSTED_NAMES[1:])


def _assemble(common: np.ndarray, percent: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["run"]):
            head = next(x for x in part.select(["classes", "sizes", "heavy"]).to_pylist() if x["classes"] is not None)
            classes, sizes = np.frombuffer(head["classes"], np.uint64).reshape(-1, 2), np.frombuffer(head["sizes"], "<u4").astype(np.int64)
            heavy = np.frombuffer(head["heavy"], np.uint32).reshape(2, -1)
            packed = np.empty(heavy.shape[1], KEY)
            packed["order"], packed["token"] = _HEAVY_ORDER + heavy[1].astype(np.int64), common[heavy[1]] if heavy.shape[1] else 0
            keys = np.concatenate([packed, *[unpack(x, rising=True) for x in part.column("tokens").to_pylist() if x]])
            rows = np.concatenate([heavy[0], *[_unplaned(unsqueeze(x)) for x in part.column("rows").to_pylist() if x]])
            goes_on = np.zeros(len(classes), bool)
            goes_on[np.concatenate([np.frombuffer(x, "<u4") for x in part.column("own").to_pylist() if x is not None])] = True
            shared = np.bincount(rows, minlength=len(classes))
            enough = goes_on & (100 * shared >= percent * sizes)
            keep = enough[rows]
            keys, rows = keys[keep], rows[keep]
            order = np.lexsort((keys["token"], keys["order"], rows))
            keys, rows = keys[order], rows[order]
            alive = np.flatnonzero(enough & (shared > 0))
            a, b = np.searchsorted(rows, alive), np.searchsorted(rows, alive, side="right")
            if len(alive):
                yield pa.RecordBatch.from_arrays([as_keys(classes[alive]), pa.array(sizes[alive]), pa.array([pack(keys[i:j]) for i, j in zip(a, b, strict=True)], pa.binary())], names=["cls", "n", "keys"])

    return go


def survivors(rows: DataFrame, sets: Sets, entities: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """(cls, n, keys): the classes that share enough tokens to be linked at all, each once, with those tokens in order."""
    size = entities.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("cls")).first()
    common = _heavy(counts, size[1])
    most, ranges = sizes_for(size[0])
    dealt = rows.mapInArrow(lean(_post(sets, ranges, common, most)), _POSTED).repartition(F.col("range"), F.when(F.col("range") < 0, F.col("run"))).sortWithinPartitions("range")
    shared = dealt.mapInArrow(lean(_count), _POSTED.split(", ", 1)[1])
    alive = shared.repartition("run").sortWithinPartitions("run").mapInArrow(lean(_assemble(common, percent)), "cls binary, n long, keys binary")
    return stored(alive, "survivors")


def _prefixes(percent: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = [np.zeros(0, np.uint64)], []
            for n, keys in zip(*[batch.column(x).to_pylist() for x in ("n", "keys")], strict=True):
                own = unpack(keys)["token"]
                least = -(-percent * n // 100)
                tokens.append(own[: max(0, n - least + 1 - (n - len(own)))])
                counts.append(len(tokens[-1]))
            classes = batch.column("cls").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), classes], names=["token", "cls"])

    return go


def blocks(alive: DataFrame, percent: int) -> DataFrame:
    """(cls, block): classes tied by prefix tokens; those that no other class can be linked with are left out."""
    prefixes = stored(alive.mapInArrow(lean(_prefixes(percent)), "token long, cls binary"), "prefixes")
    heads = prefixes.groupBy("token").agg(F.min("cls").alias("head"), F.max("cls").alias("tail"), F.count("*").alias("_held")).where("head < tail").drop("tail")
    heads = stored(heads, "heads")
    ties = hot_join(prefixes, heads.drop("_held"), "token", hot_keys(heads, "token", "_held"), "cls", "inner").where("cls > head")
    return components(ties.select(F.col("head").alias("a"), F.col("cls").alias("b"))).select(F.col("node").alias("cls"), F.col("root").alias("block"))


def chunked(rows: DataFrame, into: str = "chunk") -> DataFrame:
    """rows (block, cls, ...) with a number below ceil(block's size / CHUNK), and that bound as ``chunks``; large blocks are dealt over tasks."""
    many = stored(rows.groupBy("block").agg(F.count("*").alias("_held")).where(F.col("_held") > CHUNK), "large-blocks")
    facts = many.select("block", F.ceil(F.col("_held") / CHUNK).alias("chunks"))
    out = hot_join(rows, facts, "block", hot_keys(many, "block", "_held"), "cls").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return out.withColumn(into, F.pmod(F.xxhash64("cls"), F.col("chunks")))


def _sets(part: pa.Table) -> tuple[list[np.ndarray], list[int]]:
    return [unpack(x) for x in part.column("keys").to_pylist()], part.column("n").to_pylist()


def _join_chunks(percent: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["block", "chunk"]):
            classes = part.column("cls").to_pylist()
            keys, sizes = _sets(part)
            roots = [classes[i] for i in trie.components(keys, sizes, percent)]
            yield pa.RecordBatch.from_arrays([part.column("block").combine_chunks(), pa.array(classes, pa.binary()), pa.array(roots, pa.binary())], names=["block", "cls", "root"])

    return go


_LABELS = "block binary, cls binary, root binary"


def _join_sides(percent: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["block", "chunk", "against"]):
            side = np.array(part.column("minor").to_pylist(), bool)
            keys, sizes = _sets(part)
            roots = part.column("root").to_pylist()
            left, right = ([[x[i] for i in np.flatnonzero(side == s)] for x in (keys, sizes, roots)] for s in (False, True))
            links = trie.across(left, right, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links, strict=True)], names=["a", "b"])

    return go


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (block, cls, root) whose root is replaced by that of its component under links."""
    roots = components(links).select(F.col("node").alias("root"), F.col("root").alias("_root"))
    held = stored(labels.groupBy("root").agg(F.count("*").alias("_held")), "roots")
    out = hot_join(labels, roots, "root", hot_keys(held, "root", "_held"), "cls")
    return out.select("block", "cls", F.coalesce("_root", "root").alias("root"))


_SETS = ["block", "chunk", "cls", "n", "keys"]


def linked(alive: DataFrame, percent: int) -> DataFrame:
    """(cls, root): the components of all links between the classes; classes without links may be missing."""
    held = stored(alive.join(chunked(blocks(alive, percent)), "cls"), "blocks")
    key = held.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "cls").select(*_SETS)
    labels = stored(key.mapInArrow(lean(_join_chunks(percent)), _LABELS), "labels")
    large = held.where("chunks > 1")
    if large.isEmpty():
        return labels.select("cls", "root")
    own = large.select("cls")
    single, wide = labels.join(own, "cls", "left_anti").select("cls", "root"), labels.join(own, "cls", "left_semi")
    # the components' first sets, dealt anew
    heads = chunked(large.drop("chunk", "chunks").join(wide.where("cls = root").select("cls"), "cls", "left_semi"))
    key = heads.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "cls").select(*_SETS)
    links = key.mapInArrow(lean(_join_chunks(percent)), _LABELS).select(F.col("cls").alias("a"), F.col("root").alias("b"))
    wide = stored(_relabelled(wide, links), "labels")
    # what lies outside a block's largest component against the whole block
    sizes = wide.groupBy("block", "root").agg(F.count("*").alias("_n"))
    mains = stored(sizes.groupBy("block").agg(F.max_by("root", F.struct("_n", "root")).alias("main"), F.sum("_n").alias("_held")), "mains")
    hot = hot_keys(mains, "block", "_held")
    rows = stored(hot_join(large.join(wide.select("cls", "root"), "cls"), mains.drop("_held"), "block", hot, "cls"), "wide")
    minor = rows.where("root <> main").select("block", "cls", "n", "keys", "root", F.col("chunks").alias("of"))
    if not minor.isEmpty():
        minor = stored(chunked(minor, "against"), "minor")
        many = minor.groupBy("block").agg(F.max("chunks").alias("_many"))
        to = hot_join(rows, many, "block", hot, "cls", "inner").withColumn("against", F.explode(F.sequence(F.lit(0), F.col("_many").cast("int") - 1)))
        probes = minor.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("of").cast("int") - 1)))
        columns = ["block", F.col("chunk").cast("long"), F.col("against").cast("long"), "cls", "n", "keys", "root"]
        key = to.select(*columns, F.lit(False).alias("minor")).union(probes.select(*columns, F.lit(True).alias("minor")))
        key = key.repartition("block", "chunk", "against").sortWithinPartitions("block", "chunk", "against", "minor", "cls")
        wide = _relabelled(wide, key.mapInArrow(lean(_join_sides(percent)), "a binary, b binary"))
    return single.union(wide.select("cls", "root"))


def _first_chunks(percent: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["block", "chunk"]):
            keys, sizes = _sets(part)
            found = trie.earlier(keys, sizes, percent)
            yield pa.RecordBatch.from_arrays([part.column("cls").combine_chunks(), pa.array(found)], names=["cls", "found"])

    return go


def _first_sides(percent: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["block", "chunk", "against"]):
            side = np.array(part.column("probe").to_pylist(), bool)
            keys, sizes = _sets(part)
            places = list(zip(part.column("p1").to_pylist(), part.column("p2").to_pylist(), strict=True))
            left, right = ([[x[i] for i in np.flatnonzero(side == s)] for x in (keys, sizes, places)] for s in (False, True))
            found = np.array(trie.ahead(left, right, percent), bool)
            classes = part.column("cls").combine_chunks().take(pa.array(np.flatnonzero(side)[found]))
            yield pa.RecordBatch.from_arrays([classes], names=["cls"])

    return go


def shadowed(alive: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """(cls): the classes that are linked with a class of an earlier place; first has (cls, p1, p2), the place of each class."""
    held = stored(alive.join(chunked(blocks(alive, percent)), "cls").join(first, "cls"), "blocks")
    key = held.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "p1", "p2").select(*_SETS)
    inside = stored(key.mapInArrow(lean(_first_chunks(percent)), "cls binary, found boolean"), "inside")
    found, large = inside.where("found").select("cls"), held.where("chunks > 1")
    if large.isEmpty():
        return found
    # what no earlier set of its own chunk matched, against the block's other chunks
    open_ = large.join(inside.where("not found").select("cls"), "cls", "left_semi").withColumnsRenamed({"chunk": "home", "chunks": "of"})
    open_ = stored(chunked(open_, "against"), "open")
    probes = open_.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("of").cast("int") - 1))).where("chunk <> home")
    sizes = stored(large.groupBy("block").agg(F.count("*").alias("_held")), "large-blocks")
    many = open_.groupBy("block").agg(F.max("chunks").alias("_many"))
    to = hot_join(large, many, "block", hot_keys(sizes, "block", "_held"), "cls", "inner").withColumn("against", F.explode(F.sequence(F.lit(0), F.col("_many").cast("int") - 1)))
    columns = ["block", F.col("chunk").cast("long"), F.col("against").cast("long"), "cls", "n", "keys", "p1", "p2"]
    key = to.select(*columns, F.lit(False).alias("probe")).union(probes.select(*columns, F.lit(True).alias("probe")))
    key = key.repartition("block", "chunk", "against").sortWithinPartitions("block", "chunk", "against", "probe", "p1", "p2")
    return found.union(key.mapInArrow(lean(_first_sides(percent)), "cls binary")).distinct()
