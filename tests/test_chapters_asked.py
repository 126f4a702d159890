"""Searches read the chapters that are asked about; texts, vectors and places aren't dealt for it again and again."""

import re

import pytest
from pyspark.sql import functions as F

from loreframe.operators import fulltext
from loreframe.plans import bind, search
from tests.test_in_rows import KEYS, docs, plan

QUERIES = [(1, "red fox", "n", 1), (2, '"red fox" jumps', "n", 2), (3, "fox -red", "n", 2), (4, "red", "gone", 9)]


@pytest.fixture
def large(spark):
    """Joins as they are on tables beyond a broadcast."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string, novel string, max_chapter int")


def test_chapters_up_to_the_last_asked_about(large, tmp_path):
    """all texts were shuffled to get the numbers of their chapters."""
    rows = large.createDataFrame([(i, f"text {i}", "en", "nm"[i % 2]) for i in range(40)] + [(40, "none", "en", None)], "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    upto = search.last_chapters(asked(large))
    near = bind.chapters(large, f"file://{tmp_path}", upto=upto)
    every = bind.chapters(large, f"file://{tmp_path}")
    assert sorted(map(tuple, near.select(*every.columns).collect())) == sorted(tuple(r) for r in every.where("novel = 'n' and number <= 2").collect()) and near.count() == 2
    exchanges = lambda df: sum(bool(re.search(r"\bExchange hashpartitioning\(doc_id", line)) for line in plan(df).splitlines())
    assert exchanges(near) == 0 and exchanges(every) == 2


def test_hits_are_dealt_once(large):
    """places were shuffled for the operands, the clauses, the covers and the items of each query."""
    queries = asked(large)
    index = fulltext.positions(docs(large), {"title": "A", "body": "D"}, KEYS)
    parsed = fulltext.parse_queries(queries)
    found = fulltext.matched(queries, parsed, index, ["novel"], ["item"])
    dealt = [line for line in plan(found).splitlines() if "Exchange hashpartitioning(query_id" in line and "item" in line]
    assert dealt and not [line.strip() for line in dealt if "REPARTITION_BY_COL" not in line]
    got = {(r.query_id, r.item): r.raw for r in found.collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2)} and got[1, 1] == pytest.approx(2.3)
    assert found.where(F.col("raw").isNull()).count() == 0
