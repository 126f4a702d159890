"""Candidate joins, chains and windows against brute force."""

import numpy as np
import pytest

from loreframe.functions import text as X
from loreframe.operators import checks, entity, ingest

WORDS = ["car", "scar", "the", "red", "re", "door", "a", "doors", "key", "in", "keyhole", "lock"]


def content(text):
    return [w for w in dict.fromkeys(text.split()) if w not in X.STOPWORDS]


def known(claim, fact):
    a, b = " ".join(claim.lower().split()), " ".join(fact.lower().split())
    shared = set(content(a)) & set(content(b))
    return bool(b) and (a in b or b in a or (bool(content(a)) and len(shared) >= max(2, int(len(content(a)) * 0.5))))


@pytest.mark.parametrize("seed", range(2))
def test_knowledge_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(rng.choice(WORDS, int(rng.integers(0, n))))
    claims = [(int(rng.integers(0, 3)), i, int(rng.integers(1, 9)), text(7)) for i in range(150)] + [(0, 900, 9, ""), (1, 901, 9, "  "), (2, 902, 9, "ock in th")]
    facts = [(int(rng.integers(0, 3)), int(rng.integers(1, 9)), text(6)) for _ in range(9)] + [(0, 1, ""), (2, 2, "Lock in The door"), (2, 3, "x"), (1, 3, "c")]
    got = {r.claim_id for r in checks.check_knowledge(spark.createDataFrame(claims, "who long, claim_id long, chapter int, claim string"), spark.createDataFrame(facts, "who long, learned int, fact string"), ["who"]).collect()}
    expected = {i for who, i, chapter, claim in claims if not any(who == w and learned <= chapter and known(claim, fact) for w, learned, fact in facts)}
    assert got == expected and 10 < len(expected) < 145


def test_merge_roots_with_cycles_and_long_chains(spark):
    pairs = [(i, i - 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1001), (1004, 1003), (2000, 2000)]
    got = {r.source: r.target for r in entity.merge_roots(spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert got == {i: 0 for i in range(1, 300)} | {1001: 1000, 1002: 1000, 1003: 1000, 1004: 1000}
    assert entity.merge_roots(spark.createDataFrame([], "source long, target long")).collect() == []


def test_chains_of_places(spark):
    places = [(1, "town", ["burg"], None), (2, "inn", None, 1), (3, "cellar", ["town"], 2), (4, "barrel", [], 3), (5, "lost", [], 99), (6, "self", [], 6), (7, "x", [], 8), (8, "y", ["z"], 7)]
    kept, roots = ingest.fold_chains(spark.createDataFrame(places, "id long, name string, aliases array<string>, parent_id long"))
    assert {r.id: r.aliases for r in kept.collect()} == {1: ["barrel", "burg", "cellar", "inn"], 5: [], 6: [], 7: ["y", "z"]}
    assert {tuple(r) for r in roots.collect()} == {(2, 1), (3, 1), (4, 1), (8, 7)}


def test_chunks_are_slices(spark):
    texts = ["", None, "  \n", "one", "  a\n\nb  c\td ", "é x\U0001f600  y\n" * 40, " ".join(f"w{i}" for i in range(57))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = ingest.sliding_chunks(docs, 10, 3).collect()
    by = {}
    for r in rows:
        assert r.text[r.start - 1 : r.start - 1 + len(r.chunk)] == r.chunk and r.chunk == r.chunk.strip()
        by.setdefault(r.id, []).append((r.chunk_index, r.chunk.split()))
    for i, text in enumerate(texts):
        own = (text or "").split()
        expected = []
        for k in range(0, len(own), 7):
            expected.append((k // 7, own[k : k + 10]))
            if k + 10 >= len(own):
                break
        assert sorted(by.get(i, [])) == expected
