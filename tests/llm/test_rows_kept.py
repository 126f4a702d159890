"""What filtering and mixing keep: rows are judged each for itself, whatever their ids, and targets are met."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreframe.llm import decontaminate, mixing, ngram_join
from tests.llm.test_operators import prose


def test_near_copies_by_row(spark):
    base, other = prose(1, 60), prose(2, 60)
    rows = [
        (1, base, "a"), (1, other, "b"),  # different texts under one id: both are kept
        (2, base + " more", "c"), (None, base, "d"), (None, other + " x", "e"),  # copies, with and without an id
        (3, prose(3, 40), "f"), (3, base + " again", "g"),  # of id 3 the copy goes, the other stays
        (None, prose(4, 30), "h"), (None, prose(4, 30), "i"),  # equal rows without an id
        (5, None, "j"), (5, None, "k"), (6, "", "l"), (None, None, "m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r.k1 for r in kept.collect()]
    assert {"a", "b", "f", "l", "m"} <= set(got) and not {"c", "d", "e", "g"} & set(got)
    assert len({"h", "i"} & set(got)) == 1 and len({"j", "k"} & set(got)) == 1 and len(got) == 7
    assert ngram_join.keep_first(docs.where("false")).collect() == []


def test_copies_without_any_id_and_very_long_texts(spark):
    long = prose(8, 60_000)
    docs = spark.createDataFrame([(None, long), (None, long + " end"), (9, prose(9, 50_000))], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in ngram_join.keep_first(docs).collect()) == [0, 9]


def test_benchmark_by_row(spark):
    item, long = prose(11, 25), prose(12, 30_000)
    rows = [(1, f"{prose(13, 30)} {item}", 1), (1, prose(14, 30), 2), (None, f"{item} {prose(15, 9)}", 3), (None, prose(16, 30), 4), (2, None, 5), (3, f"{long} {item}", 6), (3, f"{long} {item}", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.clean(docs, items)
    assert got.columns == docs.columns and sorted(r._key for r in got.collect()) == [2, 4, 5]
    assert decontaminate.clean(docs, items.where("false")).count() == len(rows) and decontaminate.clean(docs.where("false"), items).count() == 0
    assert decontaminate.contaminated(docs.where("false"), items).collect() == [] == decontaminate.contaminated(docs, items.where("false")).collect()


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    rows, source = [], ["a", "b", "c", "d", None]
    for s, n in enumerate((60, 400, 900, 30, 200)):
        rows += [(1000 * s + i, prose(i, int(x)), source[s]) for i, x in enumerate(np.exp(rng.normal(2.5, 1.2, n)).clip(1, 900))]
    rows += [(9000, prose(1, 4000), "a"), (9001, prose(2, 9000), "c"), (9002, None, "a"), (9003, prose(3, 20), "b"), (9003, prose(3, 20), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs, mixing.mix(docs).cache()


def test_targets_are_met(mixed):
    _, out = mixed
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in out.collect():
        by[r.source][0] += r.size * len(r.shards)
        by[r.source][1], by[r.source][2] = r.target, r.source_size
        assert r.copies == len(r.shards) <= 3
    for taken, target, _, _ in by.values():
        assert abs(taken - target) <= 0.02 * target
    total = sum(x[2] for x in by.values())
    assert abs(sum(x[1] for x in by.values()) - total) < 1e-3


def independent(quotas, shards, seed):
    """The tree by draws without replacement from a list of all draws' sources, node by node."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(np.array(quotas), 0, shards)]
    while stack:
        have, first, count = stack.pop()
        if count == 1:
            out[first] = have
            continue
        left = count // 2
        part = np.random.default_rng([seed, first, count]).multivariate_hypergeometric(have, int(have.sum()) * left // count, method="marginals")
        stack += [(part, first, left), (have - part, first + left, count - left)]
    return out


def test_shards_follow_the_tree(mixed):
    """Each shard holds exactly the block draws that the tree gives it of each source, as a run of the source's permuted draws."""
    docs, out = mixed
    rows = out.select("doc_id", "source", "shards", F.substring(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), 1, 3).alias("block")).collect()
    blocks = defaultdict(set)
    for r in rows:
        blocks[r.source].add(r.block)
    drawn = defaultdict(set)  # (source, block, copy) -> shard; all documents of a draw are in one shard
    shard_of = {}
    for r in rows:
        for copy, shard in enumerate(r.shards):
            assert shard_of.setdefault((r.source, r.block, copy), shard) == shard
            drawn[r.source].add((copy, r.block))
    for source, held in drawn.items():
        order = [shard_of[(source, b, c)] for c, b in sorted(held)]
        assert order == sorted(order)  # disjoint runs in permuted order
    sources = sorted(blocks, key=lambda s: (s is None, s))
    quotas = [len(drawn[s]) for s in sources]
    tree = independent(quotas, 32, mixing.SEED)
    assert (tree == mixing.split(np.array(quotas), 32)).all() and tree.sum(axis=0).tolist() == quotas
    for i, source in enumerate(sources):
        ends = np.cumsum(tree[:, i])
        for k, (c, b) in enumerate(sorted(drawn[source])):
            assert shard_of[(source, b, c)] == int((ends <= k).sum())
    assert (independent(quotas, 32, 8) != tree).any()


def test_mix_reruns_and_very_long_texts(spark, mixed):
    docs, out = mixed
    again = {(r.doc_id, tuple(r.shards)) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, tuple(r.shards)) for r in out.collect()}
    long = spark.createDataFrame([(1, prose(1, 120_000), "a"), (2, "one", "b"), (3, None, None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in mixing.mix(long).collect()} == {1: 120_000, 2: 1, 3: 0}
