"""Joins of texts that share words or lie within each other: exact, without comparing all pairs of a key.

Texts meet on rows of (keys, number, word) alone; the texts come back for the pairs that are left. Sides that are exploded here
are many times what they come from, which the planner doesn't know, so these joins are told to sort: none is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.sources.files import stored

#: Letters of a word by which it is sought in longer ones.
GRAM = 4
#: Of their shared words, rarest first, so many must two texts meet on before they are compared.
FIRST = 3
#: Words of the texts of either side of a cell, texts of one side that are counted at a time, and pairs.
CELL_WORDS, CELL_TEXTS, CELL_PAIRS = 1_000_000, 4096, 4_000_000
#: A word that more than one of so many pairs of a cell share is counted by a matrix product, others by where they are.
COMMON = 75


def _join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return a.join(b.hint("merge"), on, how)


def words_of(text: str) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def first_sharing(mine: pa.ListArray, theirs: pa.ListArray, need: np.ndarray) -> np.ndarray:
    """For each of the first texts the place of one of the others that shares as many words as it needs, or -1. Texts are arrays of distinct words.

    Shared words are counted for all pairs, longest of the others first, until a text has its one.
    """
    sizes = [np.asarray(x.value_lengths().fill_null(0)) for x in (mine, theirs)]
    codes = pa.concat_arrays([mine.flatten(), theirs.flatten()]).dictionary_encode()
    n, code = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cut = int(sizes[0].sum())
    place = np.argsort(-sizes[1], kind="stable")
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    x, y = (np.repeat(np.arange(len(sizes[0])), sizes[0]), code[:cut]), (rank[np.repeat(np.arange(len(sizes[1])), sizes[1])], code[cut:])
    df = [np.bincount(c, minlength=n) for _, c in (x, y)]
    chance = df[0] * df[1]
    common = chance * COMMON > len(sizes[0]) * len(sizes[1])
    column = np.cumsum(common) - 1
    width = int(common.sum())
    x, y = ((r[k], c[k]) for r, c, k in ((*x, chance[x[1]] > 0), (*y, chance[y[1]] > 0)))

    def parts(rows, words, count):
        """(the matrix of the common words, the rows and words of the others by row)."""
        dense, some = np.zeros((count, width), np.float32), common[words]
        dense[rows[some], column[words[some]]] = 1
        order = np.argsort(rows[~some], kind="stable")
        return dense, rows[~some][order], words[~some][order]

    out = np.full(len(sizes[0]), -1, np.int64)
    left = np.flatnonzero((np.bincount(x[0], minlength=len(out)) >= need) & (need > 0))
    own, own_rows, own_words = parts(*x, len(out))
    other, other_rows, other_words = parts(*y, len(place))
    own_at = np.searchsorted(own_rows, np.arange(len(out) + 1))
    for begin in range(0, len(place), CELL_TEXTS):
        end = min(begin + CELL_TEXTS, len(place))
        lo, hi = np.searchsorted(other_rows, (begin, end))
        by_word = np.argsort(other_words[lo:hi], kind="stable")
        rows, at = other_rows[lo:hi][by_word] - begin, np.concatenate([[0], np.cumsum(np.bincount(other_words[lo:hi], minlength=n))])
        step, found = max(1, CELL_PAIRS // (end - begin)), []
        for k in range(0, len(left), step):
            some = left[k : k + step]
            shared = own[some] @ other[begin:end].T
            each = np.repeat(np.arange(len(some)), own_at[some + 1] - own_at[some])
            words = own_words[np.arange(len(each)) - np.repeat(np.cumsum(own_at[some + 1] - own_at[some]) - (own_at[some + 1] - own_at[some]), own_at[some + 1] - own_at[some]) + own_at[some][each]]
            times = at[words + 1] - at[words]
            met = rows[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - at[words], times)]
            shared += np.bincount(np.repeat(each, times) * (end - begin) + met, minlength=shared.size).reshape(shared.shape)
            best = (shared >= need[some][:, None]).argmax(axis=1)
            hit = shared[np.arange(len(some)), best] >= need[some]
            out[some[hit]] = place[begin + best[hit]]
            found.append(some[~hit])
        left = np.concatenate(found) if found else left
        if not len(left):
            break
    return out


def _one_each(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _i, _j): for each _i one _j at most from each block of b.

    The texts of a key are dealt into blocks of bounded words, and each block of a meets each of b in one task, which
    counts there. A text is sent once for each block of the other side; pairs are never dealt.
    """
    a, b = (x.where(" and ".join(f"{k} is not null" for k in keys)) for x in (a, b))  # no key equals a missing one
    words = lambda x, n: x.groupBy(*keys).agg(F.sum(F.size("_w")).alias(n))
    blocks = words(a, "_p").join(words(b, "_q").hint("merge"), keys).select(*keys, *[F.greatest(F.ceil(F.col(c) / CELL_WORDS), F.lit(1)).cast("int").alias(c) for c in ("_p", "_q")], (F.col("_p") + F.col("_q")).alias("_n"))
    blocks = stored(blocks, "blocks")
    tasks = blocks.agg(F.sum(F.when(F.col("_p") * F.col("_q") > 1, F.col("_p") * F.col("_q"))).alias("many"), F.sum(F.when(F.col("_p") * F.col("_q") == 1, F.col("_n"))).alias("few")).first()
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), (tasks.many or 0) + (tasks.few or 0) // CELL_WORDS)
    # only what is more than a cell has blocks: at most as many rows as all texts have cells
    wide = F.broadcast(blocks.where("_p > 1 or _q > 1").select(*keys, F.col("_p").alias("_ps"), F.col("_q").alias("_qs")))
    one, every = (lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)))
    own, text = [*keys, "_p", "_q"], F.array_join("_w", " ").alias("_w")  # a third of the bytes of an array
    mine = a.where((F.size("_w") >= F.col("_need")) & (F.col("_need") > 0)).join(wide, keys, "left").withColumn("_p", one("_i", "_ps")).withColumn("_q", every("_qs")).select(*own, "_i", text, "_need")
    theirs = b.where(F.size("_w") > 0).join(wide, keys, "left").withColumn("_q", one("_j", "_qs")).withColumn("_p", every("_ps")).select(*own, "_j", text)
    columns = [*keys, "_i", "_j"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return x.select([*keys, "_i"]).slice(0, 0).append_column("_j", pa.array([], y.schema.field("_j").type) if not y.num_rows else y["_j"].slice(0, 0))
        lists = [pc.split_pattern(pa.concat_arrays(t["_w"].chunks), " ") for t in (x, y)]
        at = first_sharing(*lists, x["_need"].to_numpy())
        hit = np.flatnonzero(at >= 0)
        return x.select([*keys, "_i"]).take(pa.array(hit)).append_column("_j", y["_j"].take(pa.array(at[hit])))

    schema = ", ".join(f"`{c}` {t}" for c, t in [*mine.select(*keys, "_i").dtypes, *theirs.select("_j").dtypes])
    return mine.repartition(tasks, *own).groupBy(*own).cogroup(theirs.repartition(tasks, *own).groupBy(*own)).applyInArrow(meet, schema).select(*columns)


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], fits: Column | None = None, one: bool = False) -> DataFrame:
    """(keys, _i, _j) of pairs that share at least ``_need`` words: a has (keys, _i, _w, _need), b (keys, _j, _w), with arrays of distinct words without spaces.

    With ``one`` few of the pairs of each _i are given, one at least where there are any; its pairs are counted where they meet. Else all
    pairs are given, as follows. All words are ordered by how many rows of b have them, rarest first. Of the words that a pair shares each of the first ``FIRST``
    is followed by most of ``_need`` others on either side: it is one of a's first words, and of b's words many come after
    it. Pairs that meet on as many are compared. ``fits`` may refuse pairs by other columns of both when they meet.
    """
    if one:
        if fits is not None:
            raise ValueError("one of a text's pairs is found by its words alone")
        return _one_each(a, b, keys)
    extra, other = [c for c in a.columns if c not in (*keys, "_i", "_w", "_need")], [c for c in b.columns if c not in (*keys, "_j", "_w")]
    theirs = b.select(*keys, "_j", *other, F.explode("_w").alias("_t"))
    counts = theirs.groupBy(*keys, "_t").agg(F.count("*").alias("_df"))
    own, of = W.partitionBy(*keys, "_i"), W.partitionBy(*keys, "_j")
    few = F.least(F.col("_need"), F.lit(FIRST))
    mine = _join(a.where((F.size("_w") >= F.col("_need")) & (F.col("_need") > 0)).select(*keys, "_i", "_need", *extra, F.explode("_w").alias("_t")), counts, [*keys, "_t"])
    mine = mine.withColumns({"_all": F.count("*").over(own), "_after": F.count("*").over(own) - F.row_number().over(own.orderBy("_df", "_t")) + 1})
    mine = mine.where((F.col("_all") >= F.col("_need")) & (F.col("_after") > F.col("_need") - few)).drop("_df", "_all", "_after")
    theirs = _join(theirs, counts, [*keys, "_t"]).withColumn("_left", F.count("*").over(of) - F.row_number().over(of.orderBy("_df", "_t")) + 1).drop("_df")
    met = _join(mine, theirs, [*keys, "_t"]).where(F.col("_left") > F.col("_need") - few)
    met = (met if fits is None else met.where(fits)).groupBy(*keys, "_i", "_need", "_j").agg(F.count("*").alias("_c")).where(F.col("_c") >= few).select(*keys, "_i", "_j")
    both = _join(_join(met, a.select(*keys, "_i", "_w", "_need"), [*keys, "_i"]), b.select(*keys, "_j", F.col("_w").alias("_v")), [*keys, "_j"])
    return both.where(F.size(F.array_intersect("_w", "_v")) >= F.col("_need")).select(*keys, "_i", "_j")


def contained(short: DataFrame, long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _s, _l): pairs of a text within another. short: (keys, _s), long: (keys, _l), distinct, in one case, words parted by single spaces, not empty.

    A text of three words or more has its inner words whole in the other: they meet on the rarest. One of one or two words
    lies within a run of as many words: it is sought among the distinct runs, by its first letters or by those around its space.
    """
    a = short.select(*keys, "_s", F.xxhash64("_s").alias("_i"), words_of("_s").alias("_w"), F.length("_s").alias("_n"))
    b = long.select(*keys, "_l", F.xxhash64("_l").alias("_j"), words_of("_l").alias("_w"), F.length("_l").alias("_m"))
    tokens = b.select(*keys, "_j", "_m", F.explode(F.array_distinct("_w")).alias("_t"))
    counts = tokens.groupBy(*keys, "_t").agg(F.count("*").alias("_df"))
    inner = a.where(F.size("_w") >= 3).select(*keys, "_i", "_n", F.explode(F.array_distinct(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))).alias("_t"))
    rare = _join(inner, counts, [*keys, "_t"], "left").groupBy(*keys, "_i", "_n").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("d"), "_t"))["_t"].alias("_t"))
    met = _join(rare, tokens, [*keys, "_t"]).where("_n <= _m").select(*keys, "_i", "_j")
    # one word within a word
    lead = lambda n: F.substring("_s", 1, n)
    parts = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("_t")), lambda k: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda q: F.substring(F.col("_t"), k, q))))))
    one = a.where(F.size("_w") == 1).select(*keys, "_i", "_s", lead(GRAM).alias("_g"))
    one = _join(one, counts.select(*keys, "_t", parts.alias("_g")), [*keys, "_g"]).where(F.contains("_t", F.col("_s"))).select(*keys, "_i", "_t")
    # two within two that follow each other, by two letters at most on either side of the space
    pairs = F.filter(F.zip_with("_w", F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), lambda x, y: F.concat(x, F.lit(" "), y)), lambda x: x.isNotNull())
    runs = b.select(*keys, "_j", F.explode(F.array_distinct(pairs)).alias("_t"))
    before, after = F.substring_index("_t", " ", 1), F.substring_index("_t", " ", -1)
    around = F.explode(F.array_distinct(F.array(*[F.concat(F.right(before, F.lit(x)), F.lit(" "), F.left(after, F.lit(y))) for x in (1, 2) for y in (1, 2)])))
    two = a.where(F.size("_w") == 2).select(*keys, "_i", "_s", F.col("_s").alias("_t")).withColumn("_g", F.concat(F.right(before, F.lit(2)), F.lit(" "), F.left(after, F.lit(2)))).drop("_t")
    two = _join(two, runs.select(*keys, "_t").distinct().select(*keys, "_t", around.alias("_g")), [*keys, "_g"]).where(F.contains("_t", F.col("_s"))).select(*keys, "_i", "_t")
    every = met.union(_join(one, tokens, [*keys, "_t"]).select(*keys, "_i", "_j")).union(_join(two, runs, [*keys, "_t"]).select(*keys, "_i", "_j")).distinct()
    both = _join(_join(every, a.select(*keys, "_i", "_s"), [*keys, "_i"]), b.select(*keys, "_j", "_l"), [*keys, "_j"])
    return both.where(F.contains("_l", F.col("_s"))).select(*keys, "_s", "_l")
