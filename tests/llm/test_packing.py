"""Packing against whole-text encoding, and its plan against bounds."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreframe.llm import packing, token_files
from tests.llm.test_operators import frame, prose


def whole_ids(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_files.default_tokenizer())
    return [[*own.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def checked(docs, texts, size=packing.SIZE, **more):
    """The pieces, held against the texts: every id once, sequences gapless and no longer than size. Gives tokens, padding, pieces."""
    ids, pieces = packing.pack(docs, size, **more)
    rows = packing.with_ids(ids, pieces).collect()
    expected = whole_ids(texts)
    wanted = defaultdict(list)
    for (doc_id, *_), own in zip(docs.select("doc_id").collect(), expected, strict=True):
        wanted[doc_id].append(own)
    found, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.frombuffer(r.told, "<u4").tolist()
        assert len(own) == r.length > 0
        found[r.doc_id].append((r.doc_tokens, r.start, own))
        by_sequence[r.sequence_id].append((r.offset, r.length, own))
    for doc_id, all_ids in wanted.items():
        if len(all_ids) == 1:
            assert sum((own for _, _, own in sorted(found[doc_id])), []) == all_ids[0]
            assert {n for n, _, _ in found[doc_id]} == {len(all_ids[0])}
        else:  # repeated ids: the same ids in all
            assert Counter(i for _, _, own in found[doc_id] for i in own) == Counter(i for own in all_ids for i in own)
    padding = 0
    for own in by_sequence.values():
        end = 0
        for offset, length, _ in sorted(own):
            assert offset == end
            end += length
        assert end <= size
        padding += 0 if end & (end - 1) == 0 else size - end
    assert sum(len(x) for x in expected) == sum(r.length for r in rows)
    joined = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(packing.with_ids(ids, pieces)).collect()}
    assert joined == {k: sum((x for _, _, x in sorted(v)), []) for k, v in by_sequence.items()}
    return sum(map(len, expected)), padding, len(rows)


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(4)
    texts = [None, "", "one", *(prose(i, int(n)) for i, n in enumerate(np.exp(rng.normal(3.5, 1.2, 500)).clip(0, 3000)))]
    return texts + [prose(1, 9000), prose(2, 40)] + [prose(77, 60)] * 200


def test_documents(spark, many):
    tokens, padding, pieces = checked(frame(spark, many), many, 512)
    whole = sum(-(-len(x) // 512) for x in whole_ids(many))
    assert padding <= 0.02 * tokens
    assert pieces <= whole + tokens / 512 * 1.5  # few documents are cut beyond what their length asks for


def test_sizes_that_do_not_fit_together(spark):
    """All documents have a little more than half a sequence: only cutting fills the rest."""
    texts = [prose(i, 10) for i in range(120)]
    n = max(len(x) for x in whole_ids(texts))
    size = 1 << (n - 1).bit_length()
    tokens, padding, _ = checked(frame(spark, texts), texts, size, least=1)
    assert padding == 0 and tokens


def test_hot_and_small_cases(spark):
    for texts in (["word"] * 300, [None] * 5, ["a"], [prose(1, 20_000)]):
        tokens, padding, _ = checked(frame(spark, texts), texts)
        assert padding <= 0.02 * tokens + 16
    ids, pieces = packing.pack(frame(spark, ["x"]).where("false"))
    assert packing.with_ids(ids, pieces).collect() == []


def test_null_ids_repeats_and_clashes(spark):
    rows = [(None, prose(1, 30)), (None, prose(2, 30)), (4, prose(3, 90)), (4, prose(3, 90)), (4, "other")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, ids string")
    checked(docs, [t for _, t in rows], 64, least=1)


def test_query_columns(spark, many):
    ids, pieces = packing.pack(frame(spark, many[:50]))
    rows = packing.with_ids(ids, pieces, F.crc32).collect()
    expected = dict(enumerate(whole_ids(many[:50])))
    assert all(r.told == zlib.crc32(np.array(expected[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_all_items_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 500, 3000) if seed % 2 else np.exp(rng.normal(4, 1, 3000)).astype(int).clip(1, 511)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    planned = packing.plan(histogram, 512)
    held = Counter()
    for n, pattern in planned:
        assert sum(s * k for s, k in pattern.items()) <= 512
        for s, k in pattern.items():
            held[s] += n * k
    assert held == histogram
    sizes = np.array(sorted(histogram))
    _, often, bound = packing.column_generation(sizes, np.array([histogram[s] for s in sizes.tolist()], float), 512)
    assert bound <= often.sum() * (1 + 1e-6) and bound >= lengths.sum() / 512 * 0.97
    assert sum(n for n, _ in planned) <= 1.01 * often.sum() + 2
    own = packing.slots(planned, 10)
    assert {c: s[-1][1] for c, s in own} == histogram


def test_classes(spark):
    got = spark.range(1, 4097).select("id", packing.length_class(F.col("id")).alias("c")).collect()
    for r in got:
        step = 1 << max(0, r.id.bit_length() - 1 - packing.PRECISION)
        assert r.c == -(-r.id // step) * step
    assert len({r.c for r in got}) < 500
