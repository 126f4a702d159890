"""Hard negatives by segment summaries.

Vectors are scaled to integers and packed into blocks of at most ``BLOCK`` rows. With its vectors a block stores the mean
and the deviation (norm of the differences from the mean) of ``SEGMENTS`` segments of each. Two vectors' inner product over
a segment of length L lies within L * mean * mean' -+ deviation * deviation' (Cauchy and Schwarz), so the sums over the segments
bound the score. Summaries of long segments follow from those of their halves: pairs are first bounded by ``LEVELS[0]``
segments, what may still count by ``LEVELS[1]``, and only what is left is scored exactly.

Two searches of that kind follow each other: an anchor's positives, its best rows of the same label, prune by the score
of the last of them so far; its negatives, the best rows of other labels between two shares of a positive's score, prune
by these limits and by the last negative so far.

Anchors are a stated query set that meets all rows in blocks: rows are dealt to cells of at most ``CELL`` blocks, and
packed anchors are sent to every cell. A task holds one cell's rows and one block of anchors; nothing is broadcast,
collected or emitted but each block's best rows of an anchor, which windows of a few rows an anchor reduce.

Scores are exact: sums below 2**53 are products of doubles, larger ones of Python integers, held within 64 bits.

Cases: rows without an id, a label or a vector, and vectors with a null or non-finite component, take no part; of rows with
one id the one with the least label, then vector, stays; shorter vectors count as filled up with zeros, and empty ones
score 0; ties go by the smaller id; an anchor without other rows of its label has no rows; empty tables give an empty
result; extra columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.llm.shared import lean, stored

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
BLOCK, ANCHORS, CELL, LEAST_CELLS = 4096, 1024, 16, 64
SEGMENTS, LEVELS = 8, (2, 8)
#: Blocks of anchors whose limits a task remembers, and the share of pairs up to which pairs are scored one by one.
REMEMBERED, FEW = 64, 0.1
NONE = np.iinfo(np.int64).min
PACKED = "block long, dims int, ids binary, labels binary, vectors binary, means binary, deviations binary, positives binary"
_NAMES = [c.split()[0] for c in PACKED.split(", ")]
_SCHEMA = pa.schema([("block", pa.int64()), ("dims", pa.int32()), *((n, pa.binary()) for n in _NAMES[2:])])


def vectors(rows: DataFrame, id_col: str, label_col: str | Column, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, q): one row an id, with a label and a vector of finite components; q holds floor(scale * x)."""
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    picked = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fit = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = picked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fit)
    scaled = whole.select("id", "label", F.transform("x", lambda x: F.floor(scale * x).cast("long")).alias("q"))
    return scaled.groupBy("id").agg(F.min(F.struct("label", "q")).alias("_first")).select("id", "_first.*")


def summaries(q: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of the segments of each row; the last segments are filled up with zeros."""
    length = max(1, -(-q.shape[1] // segments))
    whole = np.zeros((len(q), segments * length))
    whole[:, : q.shape[1]] = q
    parts = whole.reshape(len(q), segments, length)
    means = parts.mean(axis=2)
    return means, np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))


def merged(means: np.ndarray, deviations: np.ndarray, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The summaries of fewer, longer segments from those of their parts."""
    parts = means.reshape(len(means), segments, -1)
    mean = parts.mean(axis=2)
    own = (deviations.reshape(parts.shape) ** 2).sum(axis=2) + length * ((parts - mean[:, :, None]) ** 2).sum(axis=2)
    return mean, np.sqrt(own)


def _packed(block: int, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, positives: np.ndarray) -> list:
    means, deviations = summaries(q)
    parts = (ids.astype("<i8"), labels.astype("<i8"), q.astype("<i8"), means.astype("<f4"), deviations.astype("<f4"), positives.astype("<i8"))
    return [block, q.shape[1], *(np.ascontiguousarray(x).tobytes() for x in parts)]


def _pack(most: int) -> Callable:
    """Rows (id, label, q) and for anchors their positives' (id, score) as blocks of consecutive rows."""

    def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
        sizes = np.asarray(column.value_lengths())
        out = np.zeros((len(column), width), np.int64)
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                own = batch.slice(at, most)
                ids, labels = (own.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                q = own.column("q")
                width = max([0, *np.asarray(q.value_lengths()).tolist()])
                positives = np.zeros((len(ids), 0), np.int64)
                if "positives" in own.schema.names:
                    held = own.column("positives")
                    positives = matrix(held, max(np.asarray(held.value_lengths()).tolist()))
                    positives = np.concatenate([np.asarray(held.value_lengths())[:, None], positives], axis=1)
                order = np.argsort(ids, kind="stable")
                row = _packed(number, ids[order], labels[order], matrix(q, width)[order], positives[order])
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return go


class Block:
    """A packed block of vectors, rows in order of their ids."""

    def __init__(self, row: dict):
        self.number, self.dims = row["block"], row["dims"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        n = len(self.ids)
        self.q = np.frombuffer(row["vectors"], "<i8").reshape(n, self.dims)
        self.positives = np.frombuffer(row["positives"], "<i8").reshape(n, -1)
        self.length = max(1, -(-self.dims // SEGMENTS))
        finest = [np.frombuffer(row[c], "<f4").reshape(n, SEGMENTS).astype(float) for c in ("means", "deviations")]
        self.levels = {s: (merged(*finest, self.length, s) if s < SEGMENTS else tuple(finest)) for s in LEVELS}
        self.largest = int(np.abs(self.q).max(initial=0))
        self.norms = np.sqrt((self.q.astype(float) ** 2).sum(axis=1))


def exact(a: Block, b: Block, rows: np.ndarray | None = None, columns: np.ndarray | None = None) -> np.ndarray:
    """All scores of two blocks, or those of pairs of rows."""
    d = min(a.dims, b.dims)
    kind = float if a.largest * b.largest * max(d, 1) < 1 << 53 else object
    x, y = a.q[:, :d].astype(kind), b.q[:, :d].astype(kind)
    out = (x[rows] * y[columns]).sum(axis=1) if rows is not None else x @ y.T
    if kind is object:
        out = np.clip(out, NONE + 1, -NONE - 1) if out.size else np.zeros(out.shape)
    return out.astype(np.int64)


def bounds(a: Block, b: Block, segments: int, rows: np.ndarray | None = None, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores from the summaries of a level: of all pairs, or of pairs of rows."""
    (m, d), (n, e), length = a.levels[segments], b.levels[segments], a.length * (SEGMENTS // segments)
    if rows is None:
        middle, spread, slack = length * (m @ n.T), d @ e.T, np.outer(a.norms, b.norms)
    else:
        middle, spread, slack = length * (m[rows] * n[columns]).sum(axis=1), (d[rows] * e[columns]).sum(axis=1), a.norms[rows] * b.norms[columns]
    spread = spread + 1e-6 * slack + 1  # summaries are stored as 32-bit floats
    return middle - spread, middle + spread


def candidates(a: Block, b: Block, keep: np.ndarray, fits: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], counts: dict | None = None) -> np.ndarray:
    """Exact scores of the pairs of keep that no level's bounds rule out, NONE elsewhere.

    ``fits(rows, lower, upper)`` tells which bounds may still count; rows broadcast against the bounds.
    """
    out = np.full(keep.shape, NONE)
    rows = columns = None
    if a.length == b.length:
        for segments in LEVELS:
            if rows is None:
                keep = keep & fits(np.arange(len(a.ids))[:, None], *bounds(a, b, segments))
                if keep.mean() <= FEW:
                    rows, columns = np.nonzero(keep)
            else:
                left = fits(rows, *bounds(a, b, segments, rows, columns))
                rows, columns = rows[left], columns[left]
            if counts is not None:
                counts[segments] = counts.get(segments, 0) + (int(keep.sum()) if rows is None else len(rows))
    if rows is None:
        return np.where(keep, exact(a, b), out)
    if len(rows):
        out[rows, columns] = exact(a, b, rows, columns)
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, scores), rows x k: the highest scores of each row, ties by column; NONE where there are fewer. Clears what it takes."""
    rows = np.arange(len(scores))
    taken, values = np.zeros((len(scores), k), np.int64), np.full((len(scores), k), NONE)
    for j in range(k if scores.shape[1] else 0):
        taken[:, j] = scores.argmax(axis=1)
        values[:, j] = scores[rows, taken[:, j]]
        scores[rows, taken[:, j]] = NONE
    return taken, values


class Limits:
    """The last counting score of each anchor so far, for the blocks of anchors met last."""

    def __init__(self, shape: Callable[[Block], tuple]):
        self.shape, self.held = shape, {}

    def of(self, block: Block) -> np.ndarray:
        own = self.held.pop(block.number, None)
        self.held[block.number] = np.full(self.shape(block), NONE) if own is None else own
        while len(self.held) > REMEMBERED:
            self.held.pop(next(iter(self.held)))
        return self.held[block.number]


def _positives(k: int) -> Callable:
    """For a block of anchors and one of rows: (anchor, id, score) of the best k rows of the same label."""
    limits = Limits(lambda a: (len(a.ids), k))

    def go(a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        keep = (a.labels[:, None] == b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
        if not keep.any():
            return
        known = limits.of(a)  # rows x k: the best scores so far, rising
        last = known[:, 0]
        scores = candidates(a, b, keep, lambda rows, lower, upper: upper >= last[rows])
        columns, values = best(scores, k)
        known[:] = np.sort(np.concatenate([known, values], axis=1), axis=1)[:, -k:]
        at = values > NONE
        anchors = np.repeat(a.ids[:, None], k, axis=1)[at]
        yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(b.ids[columns[at]]), pa.array(values[at])], names=["anchor_id", "id", "score"])

    return go


def limits_of(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest negative score that satisfy low * s <= 100 * n <= high * s, for each positive score s."""
    whole = np.abs(scores).max(initial=0) < (1 << 62) // 100
    scores = scores if whole else scores.astype(object)
    least, most = -((-low * scores) // 100), (high * scores) // 100
    return least.astype(np.int64), most.astype(np.int64)


def _negatives(k: int, low: int, high: int) -> Callable:
    """For a block of anchors and one of rows: (anchor, positive, id, positive's score, score) of the best k rows of other labels within the limits."""
    limits = Limits(lambda a: (len(a.ids), (a.positives.shape[1] - 1) // 2, k))

    def go(a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        keep = a.labels[:, None] != b.labels[None, :]
        if not keep.any():
            return
        n, held = (a.positives.shape[1] - 1) // 2, a.positives[:, 0] // 2
        there = np.arange(n)[None, :] < held[:, None]
        least, most = limits_of(a.positives[:, 2::2], low, high)
        least, most = np.where(there, least, 1), np.where(there, most, 0)  # no score is within
        known = limits.of(a)
        # below the last negative so far of every positive nothing counts
        floor = np.where(least <= most, np.maximum(least, known[:, :, 0]), -NONE - 1).min(axis=1)
        ceiling = np.where(least <= most, most, NONE).max(axis=1)
        scores = candidates(a, b, keep, lambda rows, lower, upper: (upper >= floor[rows]) & (lower <= ceiling[rows]))
        for j in range(n):
            within = np.where((scores >= least[:, j, None]) & (scores <= most[:, j, None]), scores, NONE)
            columns, values = best(within, k)
            known[:, j] = np.sort(np.concatenate([known[:, j], values], axis=1), axis=1)[:, -k:]
            at = values > NONE
            wide = lambda x: pa.array(np.repeat(x[:, None], k, axis=1)[at])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([wide(a.ids), wide(a.positives[:, 1 + 2 * j]), pa.array(b.ids[columns[at]]), wide(a.positives[:, 2 + 2 * j]), pa.array(values[at])], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return go


def _cells(score: Callable[[], Callable]) -> Callable:
    """Each cell's rows come first and are held; then its blocks of anchors one by one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, each = None, [], score()
        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    cell, held = row["cell"], []
                if row["kind"] == 0:
                    held.append(Block(row))
                else:
                    a = Block(row)
                    for b in held:
                        yield from each(a, b)

    return go


def _met(blocks: DataFrame, cells: int, anchors: DataFrame, score: Callable[[], Callable], schema: str) -> DataFrame:
    rows = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")).withColumn("kind", F.lit(0))
    asked = anchors.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("kind", F.lit(1))
    dealt = rows.unionByName(asked).repartition(cells, "cell").sortWithinPartitions("cell", "kind", "block")
    return dealt.mapInArrow(lean(_cells(score)), schema)


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, label: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: a condition on ``id`` that states the query set. low and high are percentages of the positive's score.
    """
    known = stored(vectors(rows, id_col, label, vector_col, scale), "vectors")
    # a block should hold few labels: rows are sorted where they lie
    blocks = stored(known.sortWithinPartitions("label", "id").mapInArrow(lean(_pack(BLOCK)), PACKED), "vector-blocks")
    n = blocks.count()
    cells = max(1, min(n, max(LEAST_CELLS, -(-n // CELL))))
    asked = known.where(anchors)
    packed = stored(asked.repartitionByRange("label", "id").sortWithinPartitions("label", "id").mapInArrow(lean(_pack(ANCHORS)), PACKED), "anchors")
    near = _met(blocks, cells, packed, lambda: _positives(positives), "anchor_id long, id long, score long")
    near = _first(near, ["anchor_id"], "score", "id", positives)
    pairs = near.groupBy(F.col("anchor_id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda p: F.array(p["id"], p["score"]))).alias("positives"))
    told = stored(asked.join(pairs, "id").repartition("id").mapInArrow(lean(_pack(ANCHORS)), PACKED), "anchors-with-positives")
    far = _met(blocks, cells, told, lambda: _negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return _first(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The query's labels: where the id is divisible by 7 another one.
SHIFTED = "case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end"

ORACLE = """
with q as (select vec_id as id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select a.id as anchor_id, b.id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from q a, q b where a.id % 50 = 0 and a.id <> b.id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, positive_id, s.id as negative_id, positive_score, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, s.id)::int as rank
        from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
