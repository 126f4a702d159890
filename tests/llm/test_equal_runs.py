"""Partitions of equal content: each run of a task is counted and put together by itself."""

import pytest
from pyspark.sql import functions as F

from loreframe.llm import line_dedup, ngram_join, quality_lm
from tests.llm.test_operators import brute_components, edited, frame, prose


def half_alike():
    """Pairs of Jaccard similarity 0.25 to 0.75 on their shingles, none of them a link, and one pair that is."""
    base = [prose(900 + s, 60) for s in range(6)]
    return [*base, *[edited(b, 30 + k, 2 + k % 3) for k, b in enumerate(base)], *[edited(b, 60 + k, 4) for k, b in enumerate(base)], prose(950, 200), edited(prose(950, 200), 9, 1)]


def similarity(a, b):
    from tests.llm.test_operators import shingles

    a, b = set(shingles(a)), set(shingles(b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("times", [2, 4])
def test_ngram_join_of_equal_partitions(spark, times):
    texts = half_alike()
    assert sum(0.3 <= similarity(texts[i], texts[j]) <= 0.74 for i in range(6) for j in (i + 6, i + 12)) >= 8
    one = frame(spark, texts)  # not coalesced: a union of single partitions is one partition
    docs = one
    for _ in range(times - 1):
        docs = docs.union(one)
    rows = ngram_join.ngram_join(docs).collect()
    expected = brute_components(texts)
    assert len(rows) == times * len(texts) and {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(i, *x) for i, x in expected.items()}


def test_ngram_join_of_a_hot_text(spark):
    hot = prose(970, 60)
    near = [edited(hot, 40 + k, 3 + k % 2) for k in range(4)]  # each in a partition of its own, so that no token is common within one
    assert all(0.3 < similarity(hot, x) < 0.75 for x in near)
    texts = [hot] * 40 + near
    docs = frame(spark, texts[:40]).repartition(8).union(frame(spark, near, 40))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == brute_components(texts)


def test_line_dedup_of_equal_partitions(spark):
    texts = half_alike()
    one = frame(spark, texts)
    moved = one.withColumn("doc_id", F.col("doc_id") + 1000)
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(one.union(moved)).collect()}
    expected = {i: int(any(similarity(texts[i], texts[j]) >= 0.75 for j in range(i))) for i in range(len(texts))}
    assert got == expected | {i + 1000: 1 for i in expected}


def test_quality_lm_of_equal_partitions(spark):
    one = frame(spark, half_alike())
    trusted = one.where("doc_id < 6").select("doc_id")
    model = quality_lm.Model(one, trusted.withColumnRenamed("doc_id", "id"), "doc_id", "text")
    once = {r.id: r.log_perplexity for r in quality_lm.perplexity(one, model, "doc_id", "text", "lang").collect()}
    twice = quality_lm.perplexity(one.union(one), model, "doc_id", "text", "lang").collect()
    assert len(twice) == 2 * len(once) and all(r.log_perplexity == pytest.approx(once[r.id]) for r in twice)
