"""Toxicity by non-negative positive-unlabelled learning.

A document's features come from its whole text: its words without the ASCII marks around them, and the words'
beginnings of 5, 6 and 7 bytes, each as one that occurs once or more, ``LEVELS``-fold or more. The classifier is linear.
It learns from confirmed toxic documents (P) and from documents whatever their label (U), by minimising the
class-prior-corrected risk

    pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1))

with the logistic loss; where a batch's second term falls below zero, the step goes against it alone. The prior
pi is the share of toxic documents among the labelled rows that may be learnt from. Features are kept where
their share of P differs from that of U by more than ``Z`` standard errors.

What is learnt from is bounded: about ``POSITIVES`` and ``UNLABELLED`` documents, chosen by a hash of their id. Their
features, 64-bit hashes, are counted by a Spark aggregation that keeps the significant ones; the sample's rows of
these come to the driver, which fits the model in numpy. The weights go to the tasks, where every document is scored.

Cases: null and empty texts have no features and get the score of the bias; rows without labels or with null
labels are unlabelled; repeated labels of one id count as toxic if any is; without any toxic row, or with empty
tables, all scores are the prior's (0 where nothing is labelled); extra columns of documents are kept, those
that the result adds replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreframe.llm.shared import Words, grouped_counts, lean, pieces, splitmix, stored, utf8

POSITIVES, UNLABELLED = 4000, 12_000
SIZES, LEVELS, Z = (5, 6, 7), (1, 2, 3, 4, 6), 3.0
EPOCHS, RATE, DECAY, BATCHES, BETA = 20, 0.05, 1e-4, 8, 0.0
#: Features that a task counts before it hands the counts on.
RUN_FEATURES = 2_000_000


def fold(doc_id: str | Column) -> Column:
    """The remainder that says which rows are held out (0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-1)).cast("string").cast("binary")), F.lit(5))


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row's index, and the (feature, row) of each of the rows' distinct features, by row."""
    data, offsets = utf8(column)
    for i, j in pieces(offsets):
        words = Words(data, offsets[i : j + 1])
        at, starts, stops = words.cores()
        rows = np.repeat(np.arange(j - i), np.diff(words.bounds))[at]
        found = [(words.hashes_of(starts, stops), rows)]
        for size in SIZES:
            long = stops - starts >= size
            found.append((splitmix(words.hashes_of(starts[long], starts[long] + size)), rows[long]))
        hashes, rows, counts = grouped_counts(*(np.concatenate(x) for x in zip(*found, strict=True)), j - i)
        each = [(splitmix(hashes[k] + np.uint64(level)), rows[k]) for level in LEVELS if len(k := np.flatnonzero(counts >= level)) or level == 1]
        hashes, rows = (np.concatenate(x) for x in zip(*each, strict=True))
        order = np.argsort(rows, kind="stable")
        yield i, hashes[order], rows[order]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, in how many rows of P and of U)."""

    def flush(held: list) -> pa.RecordBatch:
        hashes, p, u = (np.concatenate(x) for x in zip(*held, strict=True))
        known, at = np.unique(hashes, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *[pa.array(np.bincount(at, x, len(known)).astype(np.int64)) for x in (p, u)]], names=["feature", "p", "u"])

    held, size = [], 0
    for batch in batches:
        flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("positive", "drawn")]
        for i, hashes, rows in features(batch.column("text")):
            held.append((hashes, *[f[rows + i] for f in flags]))
            size += len(hashes)
            if size >= RUN_FEATURES:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


class Chosen:
    """The features that the model has, sorted; a bitmap of their first bits turns most others away."""

    def __init__(self, known: np.ndarray):
        self.known, self.maybe = known, np.zeros(1 << 20, bool)
        self.maybe[known >> np.uint64(44)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are known, their places)."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.known, hashes[at]), max(0, len(self.known) - 1))
        same = self.known[place] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[same], place[same]


def _gather(chosen: Chosen) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[np.ndarray] = []
            for i, hashes, rows in features(batch.column("text")):
                lists += [np.zeros(0, np.int32)] * (i - len(lists))
                at, place = chosen.places(hashes)
                lists += np.split(place.astype(np.int32), np.searchsorted(rows[at], np.arange(1, rows.max(initial=0) + 1)))
            lists += [np.zeros(0, np.int32)] * (batch.num_rows - len(lists))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("drawn"), pa.array(lists, pa.list_(pa.int32()))], names=["positive", "drawn", "found"])

    return go


class Rows:
    """Sparse rows of ones."""

    def __init__(self, found: list[np.ndarray], width: int):
        self.at = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        self.n, self.width = len(found), width

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.at], self.n)

    def back(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, each[self.row], self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def significant(counts: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The features whose shares of P and U differ by more than Z standard errors, sorted."""
    p, u = F.col("p") / max(1, n_p), F.col("u") / max(1, n_u)
    error = F.sqrt((p * (1 - p) + 1 / max(1, n_p)) / max(1, n_p) + (u * (1 - u) + 1 / max(1, n_u)) / max(1, n_u))
    found = counts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.abs(p - u) > Z * error).select("feature").toArrow()
    return np.sort(found.column("feature").to_numpy().view(np.uint64))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """(weights of ``width`` features, bias) by the non-negative risk estimator, with Adam steps; rows are arrays of features' places."""
    start = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (-60.0 if prior <= 0 else 60.0)
    if not positive or not unlabelled or not 0 < prior < 1:
        return np.zeros(width), start
    rng = np.random.default_rng(seed)
    deals = [rng.permutation(len(rows)) % BATCHES for rows in (positive, unlabelled)]
    batches = []
    for b in range(BATCHES):
        p, u = ([rows[i] for i in np.flatnonzero(deal == b)] for rows, deal in zip((positive, unlabelled), deals, strict=True))
        if p and u:
            batches.append((Rows(p, width), Rows(u, width)))
    x = np.zeros(width + 1)
    x[-1] = start
    m, v, step = np.zeros_like(x), np.zeros_like(x), 0
    for _ in range(EPOCHS):
        for p, u in batches:
            gp, gu = p.times(x[:-1]) + x[-1], u.times(x[:-1]) + x[-1]
            rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            # derivatives of the losses by the outputs
            dp_minus, du_minus = prior * sigmoid(gp) / p.n, sigmoid(gu) / u.n
            if rest >= -BETA:
                dp, du = -prior * sigmoid(-gp) / p.n - dp_minus, du_minus
            else:
                dp, du = dp_minus, -du_minus
            gradient = np.append(p.back(dp) + u.back(du) + DECAY * x[:-1], dp.sum() + du.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


#: Chosen features, their weights, and the bias.
Model = tuple[Chosen, np.ndarray, float]


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """The model from the rows of docs and labels for which may_learn (over the column ``id``) holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(may_learn)
    known = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).alias("toxic")).where(may_learn & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    count, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30))
    share = lambda bound, n: int(min(1.0, bound / max(1, n)) * (1 << 30))
    ids = known.where(F.col("toxic") == 1).where(place < share(POSITIVES, toxic)).select("id", F.lit(True).alias("positive"))
    total = rows.count()
    # at most about POSITIVES ids
    marked = rows.join(F.broadcast(ids), "id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"), (place < share(UNLABELLED, total)).alias("drawn"))
    sample = stored(marked.where("positive or drawn"), "toxicity-sample")
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if("drawn")).first()
    chosen = Chosen(significant(sample.mapInArrow(lean(_count), "feature long, p long, u long"), n_p, n_u))
    found = sample.mapInArrow(lean(_gather(chosen)), "positive boolean, drawn boolean, found array<int>").toArrow()
    lists = pa.concat_arrays(found.column("found").chunks) if found.num_rows else pa.array([], pa.list_(pa.int32()))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    every = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    pick = lambda name: [every[i] for i in np.flatnonzero(found.column(name).to_numpy())]
    return chosen, *fit(pick("positive"), pick("drawn"), len(chosen.known), toxic / count if count else 0.0)


def _score(chosen: Chosen, weights: np.ndarray, bias: float, schema: pa.Schema, text: str) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for i, hashes, rows in features(batch.column(text)):
                at, place = chosen.places(hashes)
                total += np.bincount(rows[at] + i, weights[place], batch.num_rows)
            columns = [batch.column(c) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*[c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=False)], pa.array(sigmoid(total))], schema=schema)

    return go


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, unless named) with ``score``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows = docs.select(*names) if text_col in names else docs.select(*names, text_col)
    out = docs.select(*names, F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(lean(_score(*model, to_arrow_schema(out), text_col)), out)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with held_out, score and predicted; learns only from rows that aren't held out."""
    model = train(docs, labels, fold("id") != 0, id_col, text_col)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "held_out", "predicted")]
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = score(rows, model, "text", ["row", "id"])
    return scored.select("row.*", (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
