"""Media of null ids, repeated ids with different texts, clashing names, and filters of any size."""

import hashlib

import numpy as np

from loreframe.llm import media_chunks
from tests.llm.test_operators import prose


def test_rows_without_ids_repeats_and_clashes(spark):
    rows = [(None, "a"), (None, None), (1, "x"), (1, "y " * 5000), (1, "x"), (2, prose(1, 4000)), (3, prose(1, 4000) + " end"), (4, prose(1, 4000)), (None, prose(1, 4000))]
    docs = spark.createDataFrame([(*r, "m", [1], 3) for r in rows], "doc_id long, text string, media string, chunks array<int>, n_bytes int")
    got = sorted((r.doc_id or -1, r.n_bytes, r.payload_sha256, r.feature.split(";")[0]) for r in media_chunks.stored_media(docs).collect())
    expected = []
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        expected.append((i or -1, len(raw), hashlib.sha256(payload).hexdigest(), f"mean={sum(payload) * 1000 // len(payload)}"))
    assert got == sorted(expected)


def test_features_by_a_loop():
    payload = media_chunks.payload_of("é a\nZ".encode())
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
    feature = f"mean={sum(payload) * 1000 // 192};energy={sum(b * b for b in payload) // 192};crossings={crossings}"
    assert media_chunks.facts(media_chunks.to_media(payload), 6)[-1] == feature


def test_filter_grows_with_what_repeats(spark, monkeypatch):
    twice = [prose(s, 300) for s in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(twice * 2 + [prose(900 + s, 300) for s in range(40)])], "id long, text string")
    sizes = []
    for least in (6, 12):
        monkeypatch.setattr(media_chunks, "LEAST_BITS", least)
        bloom = media_chunks.repeated_filter(rows)
        sizes.append(len(bloom))
        for t in twice:
            media = media_chunks.to_media(media_chunks.payload_of(t.encode()))
            ends = media_chunks.cuts(media)
            assert all(media_chunks.repeated_in(bloom, hashlib.sha256(media[a:b]).digest()) for a, b in zip([0, *ends[:-1]], ends))
        fresh = [hashlib.sha256(f"no {i}".encode()).digest() for i in range(2000)]
        assert np.mean([media_chunks.repeated_in(bloom, d) for d in fresh]) < 0.05
    assert sizes[0] >= 40 * 10 / 64 / 2 and sizes[1] >= 64
