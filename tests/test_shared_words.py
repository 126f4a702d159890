"""Facts meet in cells that count shared words: pairs are never dealt, and blocks give what all pairs give (F3)."""

import numpy as np
import pyarrow as pa

from loreframe.operators import metrics, textjoin
from tests.test_copies import most_rows

N = 200
SCHEMA = "who long, fact_id long, fact string"


def _texts(rng, n, words=40):
    return [" ".join(f"w{int(w)}" for w in words * rng.random(int(rng.integers(0, 12))) ** 2) for _ in range(n)]


def _matched(fact, others):
    own = set(fact.split())
    return any(len(own & set(x.split())) >= max(2, len(own) // 2) for x in others)


def test_texts_that_share_a_word_are_not_dealt_as_pairs(spark):
    expected = spark.createDataFrame([(0, i, f"u v w c{i} d{i} e{i}") for i in range(N)] + [(0, N, "blue fox sat")], SCHEMA)
    actual = spark.createDataFrame([(0, i, f"{'uvw'[i % 3]} f{i} g{i}") for i in range(N)] + [(0, N, "the blue fox")], SCHEMA)
    rows, most = most_rows(metrics.score_facts(expected, actual, ["who"]))
    assert {r.fact_id for r in rows if r.matched} == {N} and len(rows) == N + 1 and most < 10 * N


def test_blocks_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    expected = [(i % 3, i, x) for i, x in enumerate(_texts(rng, 150))] + [(7, 900, "red fox"), (None, 901, "red fox"), (0, 902, None)]
    actual = [(i % 3, i, x) for i, x in enumerate(_texts(rng, 90))] + [(8, 900, "red fox"), (None, 901, "red fox"), (1, 902, None)]
    want = {i: who is not None and _matched(x or "", [y or "" for w, _, y in actual if w == who]) for who, i, x in expected}
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (expected, actual)]
    for words in (textjoin.CELL_WORDS, 60):
        monkeypatch.setattr(textjoin, "CELL_WORDS", words)
        rows = metrics.score_facts(*frames, ["who"]).collect()
        assert len(rows) == len(expected) and {r.fact_id: r.matched for r in rows} == want
    assert 30 < sum(want.values()) < 130


def test_first_sharing_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(13)
    for texts, pairs, common in ((4096, 4_000_000, 75), (5, 9, 75), (3, 1, 3), (7, 50, 10**9), (7, 50, 0)):
        for name, value in (("CELL_TEXTS", texts), ("CELL_PAIRS", pairs), ("COMMON", common)):
            monkeypatch.setattr(textjoin, name, value)
        mine, theirs = ([list(dict.fromkeys(x.split())) for x in _texts(rng, n)] for n in (60, 33))
        need = np.array([max(2, len(x) // 2) for x in mine], np.int32)
        got = textjoin.first_sharing(pa.array(mine, pa.list_(pa.string())), pa.array(theirs, pa.list_(pa.string())), need)
        for x, k, at in zip(mine, need, got, strict=True):
            assert len(set(x) & set(theirs[at])) >= k if at >= 0 else not any(len(set(x) & set(y)) >= k for y in theirs)
        assert 5 < (got >= 0).sum() < 58
