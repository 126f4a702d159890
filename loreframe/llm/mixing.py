"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into up to 4096 permuted blocks by a digest of their id. A source's target
is its weight's share of all words, at most ``most`` times its size; the excess is shared again by weight.
The target takes whole epochs of a source's blocks, then further whole blocks in permuted order. What is then missing is
filled from the block at the boundary and those after it, until they hold ``FILL`` documents: in ``ROUNDS`` rounds, documents in
permuted order that are no larger than what is missing are taken as long as they fit, so that one long document doesn't leave
its place empty. Rows that are equal in id, size and text are taken or left together. The draws of blocks are a
quota for each source; a binary tree over the output shards splits the vector of quotas by multivariate
hypergeometric draws, so that shards have exact and disjoint runs of each source's permuted blocks. Within
a shard the rows are shuffled by a digest.

What comes to the driver is one row a source. Windows hold the blocks of one source (4096 at most), or the ids and sizes,
without texts, of the documents of the block at the boundary and of less than ``FILL`` after it.

What a document gives to the mix is what the tree draws: a draw counts if the shards' runs of blocks hold its place.

Cases: a null text has size 0; documents of size 0 are drawn with the whole epochs of their source and no further; a null source is a source of its own, last in order; null ids share one
permuted place; equal rows are drawn alike unless the boundary falls between them; an empty table gives an
empty mix. Reruns agree. Extra columns are kept; columns that the result adds replace those of the same name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.llm.shared import n_words, stored

SEED = 7
#: Documents after the boundary among which a source's last words are sought, and how often.
FILL, ROUNDS = 1000, 5
#: Rows of the tables of sources and of blocks up to which they are broadcast; beyond, Spark chooses.
BROADCAST_ROWS = 200_000


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its own size."""
    total, full = sum(sizes), [False] * len(sizes)
    while True:
        rest = sum(w for w, f in zip(weights, full, strict=True) if not f)
        left = total - sum(most * s for s, f in zip(sizes, full, strict=True) if f)
        level = left / rest if rest else 0.0
        over = [i for i, f in enumerate(full) if not f and most * sizes[i] <= level * weights[i]]
        if not over:
            return [most * s if f else level * w for s, w, f in zip(sizes, weights, full, strict=True)]
        for i in over:
            full[i] = True


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: each node of the tree gives its left half a multivariate-hypergeometric part of its quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(have: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            out[first] = have
            return
        left = count // 2
        rng = np.random.default_rng([seed, first, count])
        part = rng.multivariate_hypergeometric(have, int(have.sum()) * left // count, method="marginals")
        node(part, first, left)
        node(have - part, first + left, count - left)

    node(np.asarray(quotas, np.int64), 0, shards)
    return out


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _digest(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, shards: int = 32, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix draws the row) and shards (array: the shard of each draw)."""
    spark = docs.sparkSession
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), n_words(text_col).alias("size"), _source_key(source_col).alias("_source"), _digest(id_col, seed).alias("_digest"), F.xxhash64(F.col(text_col).isNull(), text_col).alias("_content"))
    keyed = keyed.withColumn("_block", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"))
    blocks = stored(keyed.groupBy("_source", "_block").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "mixing-blocks")
    # "=" sorts code points as they are, the empty key of null goes last
    sources = sorted((r._source == "", r._source, r.words, r.blocks) for r in blocks.groupBy("_source").agg(F.sum("words").alias("words"), F.count("*").alias("blocks")).collect())
    aims = targets([r[2] for r in sources], [weights[i % len(weights)] for i in range(len(sources))], most)
    plan = [(r[1], r[2], aim, r[3], int(min(most, aim // r[2])) if r[2] else 1) for r, aim in zip(sources, aims, strict=True)]
    plan = [(*p, p[2] - p[4] * p[1] if p[1] else 0.0) for p in plan]
    facts = spark.createDataFrame(plan, "_source string, source_size long, target double, _blocks long, _epochs int, _rest double")
    order = W.partitionBy("_source").orderBy("_block")
    placed = blocks.withColumns({"_rank": F.row_number().over(order) - 1, "_end": F.sum("words").over(order), "_docs": F.sum("docs").over(order) - F.col("docs")}).withColumn("_begin", F.col("_end") - F.col("words"))
    placed = placed.join(_small(facts, len(plan)), "_source")
    beyond = (F.col("_rest") > 0) & (F.col("_end") > F.col("_rest"))
    placed = placed.withColumns({"_whole": (F.col("_rest") > 0) & ~beyond, "_first": F.min(F.when(beyond, F.struct("_docs", "_begin"))).over(W.partitionBy("_source"))})
    placed = placed.withColumn("_cut", beyond & (F.col("_docs") - F.col("_first._docs") < FILL))
    placed = stored(placed.withColumn("_missing", F.col("_rest") - F.col("_first._begin")).drop("_first", "_docs", "docs"), "mixing-plan")
    table = _small(placed.drop("words", "_end", "_begin"), sum(p[3] for p in plan))
    near = keyed.join(table, ["_source", "_block"]).where("_cut").groupBy("_source", "_block", "_digest", "_id", "size", "_content").agg((F.count("*") * F.col("size")).alias("_size"), F.first("_missing").alias("_all"))
    near = near.withColumns({"_taken": F.lit(False), "_missing": F.col("_all")})
    inside = W.partitionBy("_source").orderBy("_digest", "_id", "size", "_content").rowsBetween(W.unboundedPreceding, W.currentRow)
    for _ in range(ROUNDS):
        open_ = ~F.col("_taken") & (F.col("_size") > 0) & (F.col("_size") <= F.col("_missing"))
        near = near.withColumn("_taken", F.col("_taken") | (open_ & (F.sum(F.when(open_, F.col("_size")).otherwise(0)).over(inside) <= F.col("_missing")))).withColumn("_new", F.sum(F.when(F.col("_taken"), F.col("_size")).otherwise(0)).over(W.partitionBy("_source")))
        near = near.withColumn("_missing", F.col("_all") - F.col("_new"))
    picked = stored(near.where("_taken").select("_source", "_block", "_digest", "_content").distinct().withColumn("_more", F.lit(1)), "mixing-picked")
    # a source's draws are whole epochs, the whole blocks after them, and the blocks of what was filled in
    filled = stored(picked.select("_source", "_block").distinct().withColumn("_fill", F.row_number().over(order) - 1), "mixing-filled")
    drawn = {r._source: r.n for r in placed.groupBy("_source").agg(F.sum(F.col("_epochs") + F.col("_whole").cast("int")).alias("n")).collect()}
    more = {r._source: r.n for r in filled.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    quotas = np.array([drawn[p[0]] + more.get(p[0], 0) for p in plan], np.int64)
    ends = np.cumsum(split(quotas, shards, seed), axis=0) if len(plan) else np.zeros((shards, 0), np.int64)
    runs = spark.createDataFrame([(p[0], [int(x) for x in ends[:, i]], drawn[p[0]]) for i, p in enumerate(plan)], "_source string, _ends array<long>, _before long")
    placed = placed.join(_small(runs, len(plan)), "_source").join(_small(filled, sum(more.values())), ["_source", "_block"], "left")
    met = keyed.join(_small(placed.drop("words", "_end", "_begin"), sum(p[3] for p in plan)), ["_source", "_block"])
    cut = met.where("_cut").join(picked.drop("_block"), ["_source", "_digest", "_content"], "left").withColumn("copies", F.col("_epochs") + F.coalesce("_more", F.lit(0))).drop("_more")
    whole = met.where("not _cut").withColumn("copies", F.col("_epochs") + F.col("_whole").cast("int"))
    # the draw of a block's place falls to the shard whose run of the source's draws holds it
    place = lambda copy: F.when((copy == F.col("_epochs")) & ~F.col("_whole"), F.col("_before") + F.col("_fill")).otherwise(copy * F.col("_blocks") + F.col("_rank"))
    at = lambda copy: F.size(F.filter("_ends", lambda end: end <= place(copy)))
    wanted = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<int>"))
    out = whole.unionByName(cut).withColumn("shards", F.filter(wanted, lambda s: s < shards)).withColumn("copies", F.size("shards"))
    added = ("size", "source_size", "target", "copies", "shards")
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in added], *added)


def draws(mixed: DataFrame, columns: list[str], seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The mix's rows, one a draw, with shard and copy: in order of the shards, and shuffled within each."""
    each = mixed.select(*columns, F.posexplode("shards").alias("copy", "shard"))
    each = each.withColumn("_place", F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy")))
    return each.repartitionByRange("shard", "_place").sortWithinPartitions("shard", "_place").drop("_place")


ORACLE = r"""
with w as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('7:' || coalesce(doc_id::varchar, '')) as d from documents),
s as (select source, sum(size)::bigint as n, row_number() over (order by source nulls last) - 1 as i from w group by source),
c as (select source, n, 3.0::double * n as cap, (i % 3 + 1)::double as wt, (3.0::double * n) / (i % 3 + 1) as r from s),
l as (select *, row_number() over (order by r, source nulls last) as pos, ((select sum(n) from s) - coalesce(sum(cap) over (order by r, source nulls last rows between unbounded preceding and 1 preceding), 0))
        / sum(wt) over (order by r, source nulls last rows between current row and unbounded following) as level from c),
f as (select arg_min(level, pos) filter (cap > level * wt) as level from l),
t as (select source, n, case when f.level is null or cap <= f.level * wt then cap else f.level * wt end as target from c, f),
k as (select *, case when n > 0 then floor(target / n)::int else 1 end as e from t),
q as (select w.*, k.n, k.target, k.e, k.target - k.e * k.n as rest, substr(d, 1, 3) as b from w join k on w.source is not distinct from k.source),
b0 as (select source, b, any_value(rest) as rest, sum(size) as words, count(*) as docs from q group by all),
b1 as (select *, sum(words) over o as ends, sum(docs) over o - docs as before from b0 window o as (partition by source order by b)),
b2 as (select source, b, rest > 0 and ends <= rest as whole, rest > 0 and ends > rest as beyond, before, rest - min(ends - words) filter (rest > 0 and ends > rest) over p as missing,
        min(before) filter (rest > 0 and ends > rest) over p as first from b1 window p as (partition by source)),
m0 as (select q.doc_id, q.source, q.size, q.d, b2.missing as whole_gap, b2.missing as gap, false as taken from q join b2 on q.source is not distinct from b2.source and q.b = b2.b where beyond and before - first < 1000),
m1a as (select *, not taken and size > 0 and size <= gap as fits from m0),
m1b as (select * exclude (taken), taken or (fits and sum(case when fits then size else 0 end) over (partition by source order by d, doc_id, size rows unbounded preceding) <= gap) as taken from m1a),
m1 as (select doc_id, source, size, d, whole_gap, whole_gap - sum(case when taken then size else 0 end) over (partition by source) as gap, taken from m1b),
m2a as (select *, not taken and size > 0 and size <= gap as fits from m1),
m2b as (select * exclude (taken), taken or (fits and sum(case when fits then size else 0 end) over (partition by source order by d, doc_id, size rows unbounded preceding) <= gap) as taken from m2a),
m2 as (select doc_id, source, size, d, whole_gap, whole_gap - sum(case when taken then size else 0 end) over (partition by source) as gap, taken from m2b),
m3a as (select *, not taken and size > 0 and size <= gap as fits from m2),
m3b as (select * exclude (taken), taken or (fits and sum(case when fits then size else 0 end) over (partition by source order by d, doc_id, size rows unbounded preceding) <= gap) as taken from m3a),
m3 as (select doc_id, source, size, d, whole_gap, whole_gap - sum(case when taken then size else 0 end) over (partition by source) as gap, taken from m3b),
m4a as (select *, not taken and size > 0 and size <= gap as fits from m3),
m4b as (select * exclude (taken), taken or (fits and sum(case when fits then size else 0 end) over (partition by source order by d, doc_id, size rows unbounded preceding) <= gap) as taken from m4a),
m4 as (select doc_id, source, size, d, whole_gap, whole_gap - sum(case when taken then size else 0 end) over (partition by source) as gap, taken from m4b),
m5a as (select *, not taken and size > 0 and size <= gap as fits from m4),
m5b as (select * exclude (taken), taken or (fits and sum(case when fits then size else 0 end) over (partition by source order by d, doc_id, size rows unbounded preceding) <= gap) as taken from m5a),
m5 as (select doc_id, source, size, d, whole_gap, whole_gap - sum(case when taken then size else 0 end) over (partition by source) as gap, taken from m5b),
x as (select doc_id, d from m5 where taken)
select q.doc_id, q.size, q.n as source_size, round(q.target, 6) as target, (q.size * (q.e + case when b2.whole or x.d is not null then 1 else 0 end))::bigint as taken
  from q join b2 on q.source is not distinct from b2.source and q.b = b2.b left join x on x.d = q.d and x.doc_id is not distinct from q.doc_id
"""
