"""Quality by an interpolated modified Kneser-Ney trigram model of trusted text.

Words are 64-bit hashes and so are pairs and trigrams of them; nothing is folded into a vocabulary of fixed size.
The model is trained on all trusted documents but those kept to calibrate:

    p3(w | uv) = max(c(uvw) - D3, 0) / c(uv.) + g3(uv) * p2(w | v)
    p2(w | v)  = max(a(vw) - D2, 0) / a(v.) + g2(v) * p1(w)
    p1(w)      = max(a(w) - D1, 0) / a(.) + g1 / V

a(vw) is the number of distinct words before vw (its count where v is the start of a text), a(w) that of distinct
words before w, each D the modified discount of its level and V the number of known words and one for all others.
The first word of a text has only the start before it and takes p2.

Texts are read once into runs: packed words of about ``RUN_WORDS`` tokens. A run asks each level's table for its
distinct grams, as sorted hashes dealt to shards of the hash; a shard merges the runs or looks their grams up and
answers in the order asked, so that answers need no keys. So however common a gram is, a run asks for it once.
In training a shard tells one run of those that hold a gram to hand its count on to the level below; in scoring
words and pairs are asked first, and then only trigrams of which both pairs are known. No table is collected:
the counts of counts are all that reaches the driver.
A document is kept where its log-perplexity is at most its language's quantile of the calibration documents.

Cases: null and empty texts have no words, no perplexity and aren't kept; a null language is a language of its
own; a language without calibration documents takes the quantile over all of them; with no trusted documents
every word has probability 1 and, without a quantile, documents with words are kept; repeated rows each get
a row; a row without an id is scored and never trusted; empty tables give empty results; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.llm.setjoin import _planes, _unplaned, grouped, run_id, squeeze, unsqueeze
from loreframe.llm.shared import Words, lean, pieces, splitmix, stored, utf8

START = np.uint64(0x5354415254)
RUN_WORDS, SHARD_WORDS, LEAST_SHARDS = 1_000_000, 4_000_000, 64
QUANTILE, BIN = 0.99, 1000
_PAIR = np.uint64(0xD1342543DE82EF95)


def gram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a gram one word longer than ``before``."""
    return splitmix(splitmix(before) * _PAIR + word)


def _ints(columns: list[np.ndarray]) -> bytes:
    return squeeze(_planes(np.concatenate(columns), "<u8"))


def _columns(x: bytes, n: int) -> np.ndarray:
    """n rows, one a column of values."""
    return _unplaned(unsqueeze(x), "<u8").astype(np.int64).reshape(n, -1)


def _rising(x: np.ndarray) -> bytes:
    return _ints([np.diff(x, prepend=np.uint64(0))])


def _risen(x: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(unsqueeze(x), "<u8"), dtype=np.uint64)


# runs of texts

_RUNS = "run long, ids array<long>, langs array<string>, n array<int>, vocabulary binary, words binary"
_RUN_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about RUN_WORDS words; a row counts as one more, so that empty texts fill runs too."""
    ids, langs, n, held, size, number = [], [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        vocabulary, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_inverse=True)
        content = np.concatenate([vocabulary, np.array([x or 0 for x in ids], np.int64).view(np.uint64), np.array(n, np.uint64)])
        row = (run_id(number, content), ids, langs, n, _rising(vocabulary), squeeze(_planes(at.astype(np.uint32))))
        return _batch([row], _RUN_TYPES, _RUNS)

    for batch in batches:
        keys, names = batch.column("id").to_pylist(), batch.column("lang").to_pylist()
        data, offsets = utf8(batch.column("text"))
        for i, j in pieces(offsets):
            words = Words(data, offsets[i : j + 1])
            held.append(words.hashes)
            ids += keys[i:j]
            langs += names[i:j]
            n += np.diff(words.bounds).tolist()
            size += len(words.hashes) + j - i
            if size >= RUN_WORDS:
                yield flush()
                ids, langs, n, held, size, number = [], [], [], [], 0, number + 1
    if ids:
        yield flush()


class Run:
    """The words of a run's texts with the grams that end at each."""

    def __init__(self, row: dict):
        self.ids, self.langs, self.n = row["ids"], row["langs"], np.array(row["n"], np.int64)
        vocabulary = _risen(row["vocabulary"])
        self.words = vocabulary[_unplaned(unsqueeze(row["words"])).astype(np.int64)]
        begins = np.cumsum(self.n) - self.n
        self.first = np.zeros(len(self.words), bool)
        self.first[begins[self.n > 0]] = True
        self.later = np.flatnonzero(~self.first)
        self.before = np.concatenate([self.words[:1], self.words[:-1]])
        self.before[self.first] = START
        self.pairs = gram(self.before, self.words)
        self.trigrams = gram(self.pairs[self.later - 1], self.words[self.later])

    def known_words(self) -> np.ndarray:
        return np.unique(np.concatenate([np.array([START]), self.words]))


# tables of grams, in shards of their hashes

_DEALT = "level int, shard int, run long, keys binary, values binary, stats array<long>"
_DEALT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _deal(level: int, run: int, keys: np.ndarray, columns: list[np.ndarray], bits: int) -> list[tuple]:
    """Rows for each shard with some of the sorted keys."""
    shift, mask = np.uint64(64 - bits), np.uint64((1 << (64 - bits)) - 1)
    cuts = np.searchsorted(keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(level, k, run, _rising(keys[a:b] & mask), _ints([c[a:b] for c in columns]) if columns else None, None) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _merge(n: int) -> Callable:
    """Of each shard, a row with the sums of each gram's n values, and answers to the runs: the first value's sum for one run of each gram, 0 for the others."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["level", "shard"]):
            runs, level, shard = part.column("run").to_pylist(), part.column("level")[0].as_py(), part.column("shard")[0].as_py()
            each = [_risen(x) for x in part.column("keys").to_pylist()]
            values = np.concatenate([_columns(x, n) for x in part.column("values").to_pylist()], axis=1)
            keys, first, inverse = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, v, len(keys)).astype(np.int64) for v in values]
            few = np.bincount(np.minimum(sums[0], 5), minlength=6)[1:5].tolist()
            rows = [(level, shard, None, _rising(keys), _ints(sums), [*few, int((sums[0] > 0).sum()), int(sums[0].sum())])]
            answers = np.zeros(len(inverse), np.int64)
            answers[first] = sums[0]
            cuts = np.cumsum([0, *map(len, each)])
            rows += [(level, shard, run, None, _ints([answers[a:b]]), None) for run, a, b in zip(runs, cuts[:-1], cuts[1:], strict=True)]
            yield _batch(rows, _DEALT_TYPES, _DEALT)

    return go


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by shard, tables first: the values of the grams that each run asks for, 0 where unknown."""
    at, keys, values = None, None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            place, n = (row["level"], row["shard"]), 1 if row["level"] == 3 else 5
            if row["run"] is None:
                at, keys, values = place, _risen(row["keys"]), _columns(row["values"], n)
                continue
            asked = _risen(row["keys"])
            found = np.zeros((n, len(asked)), np.int64)
            if place == at:
                i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                found = np.where(keys[i] == asked, values[:, i], 0)
            rows.append((*place, row["run"], None, _ints(list(found)), None))
        yield _batch(rows, _DEALT_TYPES, _DEALT)


def _answers(rows: list[dict], level: int) -> np.ndarray:
    """A run's answers of a level in the order of its sorted grams."""
    n = 1 if level == 3 else 5
    own = sorted((r for r in rows if r["level"] == level), key=lambda r: r["shard"])
    return np.concatenate([np.zeros((n, 0), np.int64), *[_columns(r["values"], n) for r in own]], axis=1)


def _by_run(run: Callable, schema: str, types: list[pa.DataType]) -> Callable:
    """run(id, Run, rows of answers) for each run and its answers, giving tuples."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["run"]):
            rows = part.to_pylist()
            head = next((r for r in rows if r["ids"] is not None), None)
            if head is not None:
                yield _batch(run(head["run"], Run(head), [r for r in rows if r["ids"] is None]), types, schema)

    return go


def _with_answers(runs: DataFrame, *answers: DataFrame) -> DataFrame:
    rows = runs
    for x in answers:
        rows = rows.unionByName(x.where("run is not null").select("run", "level", "shard", "values"), allowMissingColumns=True)
    return rows.repartition("run").sortWithinPartitions("run")


def _to_shards(rows: DataFrame) -> DataFrame:
    return rows.repartition("level", "shard").sortWithinPartitions("level", "shard", "run")


# training


def _ask_trigrams(bits: int) -> Callable:
    def go(key: int, run: Run, rows: list[dict]) -> list[tuple]:
        grams, counts = np.unique(run.trigrams, return_counts=True)
        return _deal(3, key, grams, [counts], bits)

    return go


def _ask_pairs(bits: int) -> Callable:
    """Of each pair of a run: how many trigrams handed to this run end in it, and the counts of those that begin with it."""

    def go(key: int, run: Run, rows: list[dict]) -> list[tuple]:
        _, index = np.unique(run.trigrams, return_index=True)
        counts = _own(rows, 3)
        place, counts = run.later[index][counts > 0], counts[counts > 0]
        grams, at = np.unique(run.pairs, return_inverse=True)
        left, n = at[place - 1], len(grams)
        kinds = np.bincount(at[place], minlength=n) + np.bincount(at[run.first], minlength=n)
        return _deal(2, key, grams, [kinds, np.bincount(left, counts, n), *_classes(left, counts, n)], bits)

    return go


def _ask_words(bits: int) -> Callable:
    """Of each word of a run: how many pairs handed to this run end in it, and the counts of those that begin with it."""

    def go(key: int, run: Run, rows: list[dict]) -> list[tuple]:
        _, index = np.unique(run.pairs, return_index=True)
        counts = _own(rows, 2)
        place, counts = index[counts > 0], counts[counts > 0]
        words = run.known_words()
        left, n = np.searchsorted(words, run.before[place]), len(words)
        kinds = np.bincount(np.searchsorted(words, run.words[place]), minlength=n)
        return _deal(1, key, words, [kinds, np.bincount(left, counts, n), *_classes(left, counts, n)], bits)

    return go


def _own(rows: list[dict], level: int) -> np.ndarray:
    """The counts handed to a run, in the order of its grams."""
    own = sorted((r for r in rows if r["level"] == level), key=lambda r: r["shard"])
    return np.concatenate([np.zeros(0, np.int64), *[_columns(r["values"], 1)[0] for r in own]])


def _classes(groups: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """How many grams of each group have the count 1, 2, and more."""
    return [np.bincount(groups[np.minimum(counts, 3) == k], minlength=n) for k in (1, 2, 3)]


def discounts(n: np.ndarray) -> np.ndarray:
    """The modified discounts for counts 0, 1, 2 and more, from how many things have counts 1 to 4."""
    n = np.asarray(n, float)
    if n[0] <= 0 or n[1] <= 0:
        return np.array([0.0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] > 0 else 0.75]
    return np.array([0.0, *(min(max(x, 0.1), k - 0.1) for x, k in zip(d, (1, 2, 3), strict=True))])


def _trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs cut down to the texts at the places in ``kept``."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["kept"]:
                run, kept = Run(row), np.zeros(len(row["n"]), bool)
                kept[row["kept"]] = True
                vocabulary, at = np.unique(run.words[np.repeat(kept, run.n)], return_inverse=True)
                yield _batch([(row["run"], [], [], run.n[kept].tolist(), _rising(vocabulary), squeeze(_planes(at.astype(np.uint32))))], _RUN_TYPES, _RUNS)


def runs_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(lean(_runs), _RUNS), "runs")


class Model:
    """The tables of grams by level and shard, and the discounts."""

    def __init__(self, docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, runs: DataFrame | None = None):
        """trusted: ids (column ``id``) of the documents to learn from; runs: those of docs, where they are at hand."""
        runs = runs_of(docs, id_col, text_col, None) if runs is None else runs
        ids = trusted.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
        kept = runs.select("run", F.posexplode("ids").alias("place", "id")).join(ids, "id", "left_semi").groupBy("run").agg(F.collect_list("place").alias("kept"))
        learnt = stored(runs.join(kept, "run").mapInArrow(lean(_trusted), _RUNS), "learnt")
        words = int(learnt.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0])
        self.bits = max(LEAST_SHARDS, words // SHARD_WORDS).bit_length() - 1
        self.tables: dict[int, DataFrame] = {}
        self.discounts: dict[int, np.ndarray] = {}
        before: list[DataFrame] = []
        for level, ask in ((3, _ask_trigrams), (2, _ask_pairs), (1, _ask_words)):
            asked = _with_answers(learnt, *before).mapInArrow(lean(_by_run(ask(self.bits), _DEALT, _DEALT_TYPES)), _DEALT)
            table = stored(_to_shards(asked).mapInArrow(lean(_merge(1 if level == 3 else 5)), _DEALT), f"grams-{level}")
            before, self.tables[level] = [table], table.where("run is null")
            sums = self.tables[level].agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(6)]).first()
            self.discounts[level] = discounts(sums[:4])
        # of the level of words: what the discounts took, the words and one for all others, and the sum of the counts
        few, d = sums[:2], self.discounts[1]
        self.words = d[1] * few[0] + d[2] * few[1] + d[3] * (sums[4] - few[0] - few[1]), sums[4] + 1, sums[5]


def word_part(words: tuple[float, int, int], d: np.ndarray) -> Callable:
    """p1 by a word's number of kinds: what the discounts took goes to all words alike."""
    taken, known, total = words

    def p1(kinds: np.ndarray) -> np.ndarray:
        return (np.maximum(kinds - d[np.minimum(kinds, 3)], 0) + taken / known) / total if total else np.ones(len(kinds))

    return p1


def backed_off(values: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What a context leaves to the level below; all, where it is unknown."""
    return np.where(values[1] > 0, (d[1] * values[2] + d[2] * values[3] + d[3] * values[4]) / np.maximum(values[1], 1), 1.0)


def taken_off(counts: np.ndarray, totals: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The level's own part of a probability."""
    return np.where(totals > 0, np.maximum(counts - d[np.minimum(counts, 3)], 0) / np.maximum(totals, 1), 0.0)


# scoring


def _ask_words_and_pairs(bits: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                run = Run(row)
                yield _batch(_deal(1, row["run"], run.known_words(), [], bits) + _deal(2, row["run"], np.unique(run.pairs), [], bits), _DEALT_TYPES, _DEALT)

    return go


def _known_trigrams(run: Run, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of each word's pair, which later words have a known context and a known pair, and their trigrams."""
    _, at = np.unique(run.pairs, return_inverse=True)
    pairs = _answers(rows, 2)[:, at]
    asked = (pairs[1, run.later - 1] > 0) & (pairs[0, run.later] > 0)
    return pairs, asked, run.trigrams[asked]


def _ask_known(bits: int) -> Callable:
    def go(key: int, run: Run, rows: list[dict]) -> list[tuple]:
        return _deal(3, key, np.unique(_known_trigrams(run, rows)[2]), [], bits)

    return go


_SCORED = "id long, lang string, n_words long, log_perplexity double"
_SCORED_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.float64()]


def _score(d: dict[int, np.ndarray], p1: Callable) -> Callable:
    def go(key: int, run: Run, rows: list[dict]) -> list[tuple]:
        pairs, asked, trigrams = _known_trigrams(run, rows)
        words, known = _answers(rows, 1), run.known_words()
        context = words[:, np.searchsorted(known, run.before)]
        p = taken_off(pairs[0], context[1], d[2]) + backed_off(context, d[2]) * p1(words[0, np.searchsorted(known, run.words)])
        counts = np.zeros(len(run.later), np.int64)
        counts[asked] = _answers(rows, 3)[0, np.unique(trigrams, return_inverse=True)[1]]
        context = pairs[:, run.later - 1]
        p[run.later] = taken_off(counts, context[1], d[3]) + backed_off(context, d[3]) * p[run.later]
        sums = np.bincount(np.repeat(np.arange(len(run.n)), run.n), np.log(p), len(run.n)) if len(p) else np.zeros(len(run.n))
        return [(i, lang, n, -s / n if n else None) for i, lang, n, s in zip(run.ids, run.langs, run.n.tolist(), sums.tolist(), strict=True)]

    return go


def perplexity(docs: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str, runs: DataFrame | None = None) -> DataFrame:
    """(id, lang, n_words, log_perplexity) of each row; runs: those of docs, where they are at hand."""
    runs = runs_of(docs, id_col, text_col, lang_col) if runs is None else runs
    asked = runs.mapInArrow(lean(_ask_words_and_pairs(model.bits)), _DEALT)
    first = stored(_to_shards(asked.union(model.tables[1]).union(model.tables[2])).mapInArrow(lean(_answer), _DEALT), "known-pairs")
    asked = _with_answers(runs, first.where("level = 2")).mapInArrow(lean(_by_run(_ask_known(model.bits), _DEALT, _DEALT_TYPES)), _DEALT)
    second = _to_shards(asked.union(model.tables[3])).mapInArrow(lean(_answer), _DEALT)
    score = _score(model.discounts, word_part(model.words, model.discounts[1]))
    return _with_answers(runs, first, second).mapInArrow(lean(_by_run(score, _SCORED, _SCORED_TYPES)), _SCORED)


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, bins): the quantile of log-perplexity by language, in bins of 1 / BIN; a row with every true is over all languages."""
    bins = scored.where("log_perplexity is not null").groupBy("lang", F.round(F.col("log_perplexity") * BIN).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.select(F.lit(False).alias("every"), "lang", "bin", "n").union(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(True), F.lit(None).cast("string"), "bin", "n"))
    each = W.partitionBy("every", "lang")
    bins = bins.withColumns({"upto": F.sum("n").over(each.orderBy("bin")), "all": F.sum("n").over(each)})
    return bins.where(F.col("upto") >= F.lit(quantile) * F.col("all")).groupBy("every", "lang").agg(F.min("bin").alias("limit"))


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_words, log_perplexity, threshold, keep) of each row; trusted has the ids of documents known to be good.

    A fifth of the trusted documents, by crc32 of the id, calibrates the thresholds and isn't learnt from.
    """
    ids = stored(trusted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct(), "trusted")
    held_out = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0
    runs = runs_of(docs, id_col, text_col, lang_col)
    model = Model(docs, ids.where(~held_out), id_col, text_col, runs)
    scored = stored(perplexity(docs, model, id_col, text_col, lang_col, runs), "perplexity")
    limits = stored(thresholds(scored.join(ids.where(held_out), "id", "left_semi"), quantile), "thresholds")
    own, every = limits.where("not every").select(F.col("lang").alias("_lang"), F.col("limit").alias("_own")), limits.where("every").select(F.col("limit").alias("_every"))
    out = scored.join(own, scored["lang"].eqNullSafe(own["_lang"]), "left").join(F.broadcast(every), F.lit(True), "left")
    limit = F.coalesce("_own", "_every")
    keep = F.col("log_perplexity").isNotNull() & F.coalesce(F.round(F.col("log_perplexity") * BIN).cast("long") <= limit, F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_words", "log_perplexity", (limit / BIN).alias("threshold"), keep.alias("keep"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)).select("doc_id")
