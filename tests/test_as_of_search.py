"""Canon before a chapter, scoped vector search, and names in compatibility forms, against loops."""

import itertools

import numpy as np
import pytest

from loreframe.operators import entity, folds, retrieval


def test_canon_before(spark):
    rng = np.random.default_rng(1)
    log = [(int(k), int(q), "abc"[int(rng.integers(3))], [0.2, 0.5, 0.9, 1.0, 0.0, None][int(rng.integers(6))]) for k in range(6) for q in rng.choice(40, 12, replace=False)]
    locked, fixed = [(1, 15), (2, 0), (3, 39)], [(1, 30, "X"), (4, 5, "Y")]
    points = [(k, n) for k in range(7) for n in (0, 1, 9, 16, 31, 40)]
    lock = dict(locked)
    expected = set()
    for k, n in points:
        best = None
        for q, v, c, manual in sorted([(q, v, c, False) for j, q, v, c in log if j == k] + [(q, v, 1.0, True) for j, q, v in fixed if j == k]):
            c = 1.0 if not c else min(max(c, 0.0), 1.0)
            if q < n and (manual or k not in lock or q <= lock[k]) and (best is None or c >= best[1]):
                best = v, c
        if best:
            expected.add((k, n, best[0]))
    frames = [spark.createDataFrame(x, s) for x, s in ((log, "k long, seq long, value string, confidence double"), (points, "k long, chapter long"), (locked, "k long, lock_seq long"), (fixed, "k long, seq long, value string"))]
    got = folds.canon_before(frames[0], frames[1], ["k"], frames[2], frames[3]).collect()
    assert {(r.k, r.chapter, r.value) for r in got} == expected and len(got) == len(expected)
    assert all(r.locked == (r.k in lock and lock[r.k] < r.chapter) for r in got if r.k in (1, 3))
    final, _ = folds.fold_canon(frames[0], ["k"], frames[2], frames[3])
    assert {(r.k, r.value) for r in final.collect()} == {(k, v) for k, n, v in expected if n == 40}


@pytest.mark.parametrize("product", [256, 2])
def test_dense_search_sees_no_other_novel_model_or_later_chapter(spark, product, monkeypatch):
    monkeypatch.setattr(retrieval, "PRODUCT", product)
    rng = np.random.default_rng(2)
    items = [(i, [float(x) for x in rng.normal(size=5)], f"n{i % 3}", int(rng.integers(1, 9)), f"m{i % 2}") for i in range(120)] + [(900, None, "n0", 1, "m0"), (901, [1.0], "n0", 1, "m0"), (902, [0.0] * 5, "n1", None, "m0")]
    asked = [(k, [float(x) for x in rng.normal(size=5)], f"n{k % 4}", [None, 4, 0][k % 3]) for k in range(9)]
    expected = []
    for q, v, novel, most in asked:
        scores = []
        for i, x, n, c, m in items:
            if x is not None and len(x) == 5 and n == novel and m == "m0" and c is not None and (most is None or c <= most):
                size = np.linalg.norm(x) * np.linalg.norm(v)
                scores.append((-round(float(np.clip(np.dot(x, v) / size if size else 0, 0, 1)), 9), i))
        expected += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:7])]
    I, Q = spark.createDataFrame(items, "item long, vector array<double>, novel string, chapter int, embedding_model string"), spark.createDataFrame(asked, "query_id long, vector array<double>, novel string, max_chapter int")
    got = retrieval.dense_search(Q, I.repartition(3), 5, 7, scope=("novel",), model="m0").collect()
    got = sorted(got, key=lambda r: (r.query_id, r["rank"]))
    assert [(r.query_id, r.item, pytest.approx(r.score), r["rank"]) for r in got] == expected
    left_out = {(r.novel, r.models) for r in retrieval.excluded_models(I, "m5", ["novel"]).collect()}
    assert left_out == {(f"n{k}", "m0, m1") for k in range(3)} and retrieval.excluded_models(I, "m0", ["novel"]).count() == 0


def test_names_in_compatibility_forms_are_one_surface(spark):
    names = [(0, 1, "Full Name", []), (0, 2, "\uff26\uff55\uff4c\uff4c\u3000\uff2e\uff41\uff4d\uff45", []), (0, 3, "\ufb01rst", ["First!"]), (0, 4, "Z\u00f6e", ["Zo\u0308e"]), (0, 5, None, [None, ""])]
    rows = spark.createDataFrame([(*x, "character") for x in names], "novel long, id long, name string, aliases array<string>, entity_type string")
    got = {(r.id, r.surface, r.is_name) for r in entity.surfaces(rows, ["novel"]).collect()}
    assert got == {(1, "full name", True), (2, "full name", True), (3, "first", True), (4, "z\u00f6e", True)}


def test_near_surfaces_of_random_names(spark):
    rng = np.random.default_rng(3)
    names = {"".join(rng.choice(list("ab c"), int(n))).strip() for n in rng.integers(1, 12, 60)} - {""}
    names |= {"".join(x) for x in itertools.product("xy", repeat=4)} | {"lord of the long river bank", "lord of a long river bank", "of the long river bank lord"}
    rows = spark.createDataFrame([(0, n) for n in names], "novel long, surface string")
    for least in (0.85, 0.7):
        expected = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if entity._ratio([a], [b])[0] >= least}
        got = [(r.a, r.b) for r in entity.near_surfaces(rows, ["novel"], least).collect()]
        assert set(got) == expected and len(got) == len(expected)
