"""Host reputation against a plain loop, on known bad hosts and on the given tables."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from loreframe.llm import queries, url_filter


def brute(pages, outcomes):
    """{host: blocked} by the levels host, domain (last two labels), suffix (last label) and all pages."""
    bad_of = dict(outcomes)
    hosts = defaultdict(lambda: [0, 0])
    for page_id, url in pages:
        host = url.split("://")[1].split("/")[0]
        if page_id in bad_of:
            hosts[host][0] += 1
            hosts[host][1] += bad_of[page_id]
        else:
            hosts[host]
    up = [lambda h: tuple(h.split(".")[-2:]), lambda d: d[-1], lambda s: None]
    levels = [dict(hosts)]
    for of in up:
        held = defaultdict(lambda: [0, 0])
        for key, (n, bad) in levels[-1].items():
            held[of(key)][0] += n
            held[of(key)][1] += bad
        levels.append(dict(held))
    n, bad = levels[3][None]
    base = (bad + 0.5) / (n + 1)
    mean, kappa = {None: base}, None
    for level, of in ((2, up[2]), (1, up[1]), (0, up[0])):
        own = levels[level]
        prior = {k: mean[of(k)] for k in own}
        over = sum((b - c * prior[k]) ** 2 - c * prior[k] * (1 - prior[k]) for k, (c, b) in own.items() if c >= 2)
        room = sum(c * (c - 1) * prior[k] * (1 - prior[k]) for k, (c, b) in own.items() if c >= 2)
        rho = max(1 / (url_filter.MOST + 1), min(0.999, over / room if room > 0 else 0.5))
        kappa = 1 / rho - 1
        mean = {k: (b + kappa * prior[k]) / (c + kappa) for k, (c, b) in own.items()}
    return {h: m - math.sqrt(m * (1 - m) / (hosts[h][0] + kappa + 1)) > base for h, m in mean.items()}


def corpus(seed):
    """Forty hosts of ten domains; two hosts are bad, one of them has a third of all pages."""
    rng = np.random.default_rng(seed)
    hosts = [f"{x}.site{d}.{'org' if d % 2 else 'io'}" for d in range(10) for x in ("www", "m", "blog", "shop")]
    weights = np.ones(40)
    weights[5] = 20
    rate = np.full(40, 0.1)
    rate[[5, 17]] = 0.9
    at = rng.choice(40, 1500, p=weights / weights.sum())
    pages = [(i, f"https://{hosts[h]}/p{i}") for i, h in enumerate(at)]
    outcomes = [(i, int(rng.random() < rate[h])) for i, h in enumerate(at) if rng.random() < 0.5]
    return pages, outcomes, hosts


@pytest.mark.parametrize("seed", [1, 2])
def test_known_bad_hosts(spark, seed):
    pages, outcomes, hosts = corpus(seed)
    rows = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), rules=()).collect()
    got = {r.host: r.verdict == "block" for r in rows}
    assert len(rows) == len(pages) and got == brute(pages, outcomes)
    assert got[hosts[5]] and got[hosts[17]] and sum(got.values()) <= 6


def test_repeats_ties_of_rules_and_clashes(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "r", 1.0), (1, "http://a.b/x", "r", 1.0), (None, "http://a.b/y", None, None), (None, None, None, None)], "page_id long, url string, rule string, bound double")
    rules = (("b", "/x", "block"), ("a.b", "/", "allow"))  # a.b/ and b/x: four letters and three
    rows = url_filter.url_filter(pages, spark.createDataFrame([(1, 1)], "page_id long, bad int"), rules).collect()
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in rows) == [(0, "", "allow"), (0, "a.b/", "allow"), (1, "a.b/", "allow"), (1, "a.b/", "allow")]
    assert set(rows[0].asDict()) == {"page_id", "url", "rule", "bound", "host", "path", "verdict"}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_both_verdicts_without_a_rule(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    found = {r.verdict for r in queries.op7_url_filter(spark, sf).where("rule is null").select("verdict").distinct().collect()}
    assert found == {"allow", "block"}
