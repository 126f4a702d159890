"""Payoffs: the early end of the sequence ratio, and how much reaches the greedy step."""

import difflib
import random

import pandas as pd

from loreframe.operators import entity, ingest


def test_ratio_is_difflibs():
    rng, found = random.Random(3), 0
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz    eeeettaa", "aé\U0010ffff😀"])
        y = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 150, 230, 500])))
        x = list(y) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 150, 260]))]
        for _ in range(rng.randrange(30) if x else 0):
            x[rng.randrange(len(x))] = rng.choice(letters)
        x = "".join(x[len(x) // 3 :] + x[: len(x) // 3] if rng.random() < 0.3 else x)
        ratio, want = entity.Ratio(y), difflib.SequenceMatcher(None, x, y).ratio()
        assert ratio(x) == want
        for least in (0.3, 0.45, 0.75):
            assert ratio(x, least) in ((want,) if want >= least else (want, 0.0))
        found += want >= 0.45
    assert found > 300


def test_greedy_step_gets_no_more_than_the_commitments_ask_for(spark, monkeypatch):
    """Two commitments that every payoff fits: two payoffs of each are enough, and the first two take them."""
    sizes = []
    run = type(spark.range(1).groupBy()).applyInPandas

    def watched(self, f, schema):
        sizes.append(self._df.count())
        return run(self, f, schema)

    monkeypatch.setattr(type(spark.range(1).groupBy()), "applyInPandas", watched)
    payoffs = spark.createDataFrame(pd.DataFrame({"novel": 0, "payoff_id": range(40), "payoff_seq": range(100, 60, -1), "matches": "the bell will ring at dawn", "payoff": "x"}))
    commitments = spark.createDataFrame([(0, 1, "the bell will ring at dawn"), (0, 2, "the bell will ring at noon"), (1, 3, "x")], "novel long, commitment_id long, foreshadow string")
    got = sorted((r.payoff_id, r.commitment_id) for r in ingest.match_payoffs(payoffs, commitments, ["novel"]).collect())
    assert got == [(38, 2), (39, 1)] and sizes == [4]
