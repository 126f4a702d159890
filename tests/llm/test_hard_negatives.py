"""Hard negatives against brute force."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreframe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=H.EVERY):
    known = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        single = [struct.unpack("f", struct.pack("f", v))[0] for v in x]
        row = (label, [math.floor(256 * v) for v in single])
        known[vec_id] = min(known.get(vec_id, row), row)
    out = []
    for a, (label, q) in known.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, other, strict=False)), i, own) for i, (own, other) in known.items() if i != a)
        for s, p, own in [x for x in scores if x[2] == label][:5]:
            fit = [(i, -t) for t, i, other in scores if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, anchors=None):
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.hard_negatives(df, F.col("id") % H.EVERY == 0 if anchors is None else anchors)
    return sorted(tuple(r) for r in got.collect())


def clustered(seed, n, dims, labels, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    x = centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_brute(spark, monkeypatch, small):
    if small:  # many blocks, cells and anchors' blocks; workers read these from the driver's closures
        monkeypatch.setattr(H, "LEAST_CELLS", 3)
        monkeypatch.setattr(H, "CELL", 2)
    rows = clustered(1, 1500, 24, 4)
    rows += [(1500 + i, rows[7][1], rows[7][2]) for i in range(300)]  # one vector many times, ties
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = clustered(2, 120, 7, 2)
    rows += [(None, rows[0][1], 0), (200, None, 0), (201, rows[0][1], None), (202, [float("nan")] * 7, 1), (203, [1.0, None], 1), (204, [float("inf")], 1)]
    rows += [(250, [], 0), (251, [0.5], 1), (3, rows[3][1], rows[3][2]), (5, rows[6][1], 0), (300, [0.0] * 7, 1), (350, [1.0] * 7, 77)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    big = [(i, [3e9 * (1 + i % 3), -2e9 + i], i % 2) for i in range(0, 400, 10)]
    assert found(spark, big) == brute(big)
    clash = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", block string, rank int")
    assert sorted(tuple(r) for r in H.hard_negatives(clash, F.col("id") % 50 == 0).collect()) == brute(rows)


def _block(rows):
    q = np.array([[math.floor(256 * v) for v in x] for _, x, _ in rows])
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    return H.Block(dict(zip(H._NAMES, H._packed(0, ids, labels, q, np.zeros((len(ids), 0), np.int64)), strict=True)))


def test_bounds_hold_and_rule_out():
    a, b = _block(clustered(3, 60, 64, 3)), _block(clustered(3, 2000, 64, 3))
    scores = H.exact(a, b)
    widths = []
    for segments in H.LEVELS:
        lower, upper = H.bounds(a, b, segments)
        assert (lower <= scores).all() and (scores <= upper).all()
        widths.append((upper - lower).mean())
    assert widths == sorted(widths, reverse=True)
    # a smooth signal: few segments say nearly all, so that hardly any pair is scored exactly
    t = np.linspace(0, 3, 64)
    smooth = [(i, [float(v) for v in np.sin(t + i / 40)], 0) for i in range(2000)]
    a, b, counts = _block(smooth[:40]), _block(smooth), {}
    last = np.sort(H.exact(a, b), axis=1)[:, -5]
    kept = H.candidates(a, b, np.ones((40, 2000), bool), lambda rows, lower, upper: upper >= last[rows], counts)
    assert counts[H.LEVELS[-1]] < 0.2 * 40 * 2000
    columns, values = H.best(kept, 5)
    assert (values == -np.sort(-H.exact(a, b), axis=1)[:, :5]).all()
