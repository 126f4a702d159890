"""Full text with positions: parsing, phrases and covers against brute force, pruning of the index, fusion over kinds."""

import itertools
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreframe.functions import text as X
from loreframe.operators import fulltext, retrieval
from loreframe.plans import fulltext as plans

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def parsed(query):
    """(relaxed, [clause of (negated, [(offset, term)])]) in plain Python."""
    clauses = [[]]
    for token in re.findall(r'-?"[^"]*"?|[^\s"]+', query):
        if token.lower() == "or":
            clauses.append([])
            continue
        terms = [(i, t) for i, t in enumerate(tokens(token)) if t not in X.STOPWORDS]
        for group in ([terms] if '"' in token else [[t] for t in terms]):
            if group:
                clauses[-1].append((token.startswith("-"), [(i - group[0][0], t) for i, t in group]))
    relaxed = not any(n for c in clauses for n, _ in c)
    if relaxed:
        clauses = [[x] for c in clauses for x in c]
    return relaxed, [c for c in clauses if c]


def brute(query, fields):
    """The sum over all minimal runs of places in which the query holds, tried one by one."""
    _, clauses = parsed(query)
    place, doc = 0, {}
    for text, weight in fields:
        for t in tokens(text):
            place += 1
            if t not in X.STOPWORDS:
                doc[place] = (t, weight)
    at = lambda b, e, terms: any(all(doc.get(p + o, ("",))[0] == t and b <= p + o <= e for o, t in terms) for p in range(b, e + 1))
    alive = [c for c in clauses if not any(n and at(1, place, terms) for n, terms in c)]
    positive = [[terms for n, terms in c if not n] for c in alive]
    holds = lambda b, e: any(c and all(at(b, e, terms) for terms in c) for c in positive)
    named = {t for c in clauses for _, terms in c for _, t in terms}
    runs = [(b, e) for b in range(1, place + 1) for e in range(b, place + 1) if holds(b, e)]
    minimal = [r for r in runs if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in runs)]
    total = 0.0
    for b, e in minimal:
        own = [1 / doc[p][1] for p in range(b, e + 1) if p in doc and doc[p][0] in named]
        total += len(own) / sum(own) / (1 + (e - b) - (len(own) - 1))
    return round(total, 9)


WORDS = ["red", "fox", "the", "jumps", "over"]
QUERIES = ["red fox", '"red fox"', '"red fox" jumps', "red or fox", 'red fox or "jumps over"', "red -fox", "red fox -jumps", '"red fox" over or jumps -"over red"', '"red the fox"', "-red", "the", "", '"red', "red or or fox", "red OR -fox", '"red red"', "red red fox", '"fox jumps" "red fox" -over']


def test_against_all_runs(spark):
    rng = np.random.default_rng(5)
    docs = [(i, 1, " ".join(rng.choice(WORDS, rng.integers(0, 4))), " ".join(rng.choice(WORDS, rng.integers(0, 9)))) for i in range(60)] + [(60, 1, None, None), (61, 9, "red fox", "red fox")]
    rows = spark.createDataFrame(docs, "item long, chapter int, title string, body string").withColumn("novel", F.lit("n"))
    queries = spark.createDataFrame([(k, q, "n", 5) for k, q in enumerate(QUERIES)], "query_id long, text string, novel string, max_chapter int")
    index = fulltext.positions(rows, {"title": "A", "body": "D"}, ["novel", "chapter", "item"])
    got = {(r.query_id, r.item): r.raw for r in fulltext.matched(queries, fulltext.parse_queries(queries), index, ["novel"], ["item"]).collect()}
    expected = {(k, i): s for k, q in enumerate(QUERIES) for i, chapter, title, body in docs if chapter <= 5 and (s := brute(q, [(title, 1.0), (body, 0.1)])) > 0}
    assert set(got) == set(expected)
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in expected)
    assert len({k for k, _ in got}) >= 12


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=9), st.sampled_from(QUERIES))
def test_cover_density(doc, query):
    _, clauses = parsed(query)
    places = {p + 1: t for p, t in enumerate(doc) if t not in X.STOPWORDS}
    occurrences, needs = [], {}
    for c, clause in enumerate(clauses):
        own = [[(p, p + terms[-1][0]) for p in places if all(places.get(p + o) == t for o, t in terms)] for negated, terms in clause]
        if any(n and found for (n, _), found in zip(clause, own, strict=True)):
            continue
        needs[c] = sum(not n for n, _ in clause)
        if needs[c] and all(found for (n, _), found in zip(clause, own, strict=True) if not n):
            occurrences += [(e, b, c, k) for k, ((n, _), found) in enumerate(zip(clause, own, strict=True)) if not n for b, e in found]
    named = {t for c in clauses for _, terms in c for _, t in terms}
    got = fulltext.cover_density(occurrences, needs, [(p, 0.4) for p, t in places.items() if t in named])
    assert abs(got - brute(query, [(" ".join(doc), 0.4)])) < 1e-6


def test_index_is_pruned_by_terms(spark, tmp_path):
    rows = spark.createDataFrame([("n", 1, i, f"word{i} common") for i in range(50)], "novel string, chapter int, item long, text string")
    index = fulltext.positions(rows, {"text": "A"}, ["novel", "chapter", "item"])
    fulltext.write_index(index, f"file://{tmp_path}/i", 8)
    terms = spark.createDataFrame([("word7",), ("absent",)], "term string")
    got = fulltext.read_index(spark, f"file://{tmp_path}/i", terms, 8)
    assert got.where("term = 'word7'").count() == 1 and len(got.inputFiles()) >= 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "term_bucket" in plan
    assert got.select("term").distinct().count() < index.select("term").distinct().count()
    assert {(r.item, r.term, tuple(r.places)) for r in spark.read.parquet(f"file://{tmp_path}/i").select("item", "term", "places").where("item = 3").collect()} == {(3, "word3", (1,)), (3, "common", (2,))}


def test_fusion_of_kinds(spark):
    keyword = spark.createDataFrame([(1, "chapter", 5, 1), (1, "scene", 5, 1), (1, "event", 8, 1), (2, "event", 3, 1)], "query_id long, kind string, item long, rank int")
    dense = spark.createDataFrame([(1, "scene", 5, 1), (1, "chapter", 6, 1)], "query_id long, kind string, item long, rank int")
    got = [tuple(r) for r in fulltext.fused(keyword, dense, ["chapter", "scene", "event"]).orderBy("query_id", "rank").collect()]
    one = round(1 / 61, 12)
    assert got == [(1, "scene", 5, round(2 / 61, 12), 1, 2), (1, "chapter", 5, one, 2, 0), (1, "chapter", 6, one, 3, 1), (1, "event", 8, one, 4, 4), (2, "event", 3, one, 1, 4)]


def mmr_loop(rows, vectors, weight=0.7, top_k=10):
    best = max(s for _, s, _ in rows)
    left, out = sorted(rows, key=lambda r: r[2]), []
    while left and len(out) < top_k:
        def value(row):
            v = vectors.get(row[0])
            near = [0.0] + [float(np.dot(v, vectors[o]) / (np.linalg.norm(v) * np.linalg.norm(vectors[o]))) for o, _ in out if v is not None and o in vectors]
            return round(weight * row[1] / best - (1 - weight) * max(near), 12)
        pick = max(left, key=lambda r: (value(r), -r[2]))
        out.append((pick[0], value(pick)))
        left.remove(pick)
    return [x for x, _ in out]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_diversified_search_against_a_loop(spark):
    fused = plans.fused_lists(spark, SF).collect()
    vectors = {(r.kind, r.item): np.array(r.vector, float) for r in plans.item_vectors(spark, SF).collect()}
    got = {}
    for r in plans.diversified_search(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.kind, r.item))
    for query_id, own in itertools.groupby(sorted(fused, key=lambda r: r.query_id), key=lambda r: r.query_id):
        assert got[query_id] == mmr_loop([((r.kind, r.item), r.score, r.rank) for r in own], vectors)


def test_dense_search_of_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)], "ab"[i % 2]) for i in range(80)], "item long, vector array<double>, kind string")
    queries = items.where("item < 20").select(F.col("item").alias("query_id"), "vector")
    whole = sorted(tuple(r) for r in retrieval.dense_search(queries, items, 4, limit=3, kind=True).collect())
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 200)
    assert sorted(tuple(r) for r in retrieval.dense_search(queries, items, 4, limit=3, kind=True).collect()) == whole
    assert len(whole) == 20 * 2 * 3
