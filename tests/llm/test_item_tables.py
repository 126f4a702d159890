"""Both ways of looking up fingerprints find the same items; ties of equal windows; items of one size in numbers."""

import numpy as np
import pytest

from loreframe.llm import decontaminate
from tests.llm.test_operators import edited, prose


@pytest.mark.parametrize("room", [0, 1 << 24])
def test_lookups_find_what_distances_find(monkeypatch, room):
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", room)
    texts = [prose(s, 20) for s in range(60)] + [edited(prose(s, 20), s, 2) for s in range(60)] + [prose(500, 12)]
    index = decontaminate.Index(list(range(len(texts))), texts, 5, decontaminate.RADIUS)
    assert (index.tables(20)[1] is None) == (room == 0)
    rng = np.random.default_rng(1)
    prints = index.prints[:300].copy()
    flips = rng.integers(0, 256, (len(prints), 60))
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    for row, own in zip(bits, flips):
        row[own] ^= 1
    prints = np.packbits(bits, axis=1).view(np.uint64)
    of = np.flatnonzero(index.sizes == 20)
    expected = {(w, i) for w in range(len(prints)) for i in of if decontaminate.distances(prints[w], index.prints[i]) <= decontaminate.RADIUS}
    windows, items = index.within(20, prints)
    assert set(zip(windows.tolist(), items.tolist())) == {(w, int(i)) for w, i in expected} and len(expected) >= 60


def test_ties_of_windows_and_repeated_rows(spark, monkeypatch):
    item = prose(1, 12)
    docs = spark.createDataFrame([(1, f"{item} x y {item}"), (1, f"{item} x y {item}"), (2, f"a {item}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    expected = [(1, 7, 0), (1, 8, 0), (2, 7, 1), (2, 8, 1)]
    for most in (50_000, 1):
        monkeypatch.setattr(decontaminate, "ITEMS", most)
        assert sorted((r.doc_id, r.item_id, r.first_word) for r in decontaminate.contaminated(docs, items).collect()) == expected
