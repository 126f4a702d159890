"""A search that comes once deals the terms that are asked for alone, with the results of a search of all terms."""

from pyspark.sql import functions as F

from loreframe.operators import fulltext, retrieval

KEYS = ["novel", "chapter", "item"]
DOCS = [("n", 1, 1, "red fox", "the red fox ran home"), ("n", 2, 2, "blue", "a fox and a fox"), ("n", 9, 3, "red", "fox"), ("m", 1, 4, "red", "fox"), ("n", 3, 5, "the", "of")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "novel string, chapter int, item long, title string, text string")


def _wanted(spark, last):
    return spark.createDataFrame([("n", t, last) for t in ("red", "fox")], "novel string, term string, last int")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_positions_of_asked_terms(spark):
    fields = {"title": "A", "text": "D"}
    every, some = fulltext.positions(_docs(spark), fields, KEYS), fulltext.positions(_docs(spark), fields, KEYS, _wanted(spark, 5))
    assert _rows(some) == _rows(every.where("novel = 'n' and chapter <= 5 and term in ('red', 'fox')").select(*some.columns)) and some.count() == 5


def test_searches_of_asked_terms(spark):
    fields = {"title": "A", "text": "D"}
    queries = spark.createDataFrame([(1, "red fox", "n", 5), (2, "fox -red", "n", 5)], "query_id long, text string, novel string, max_chapter int")
    every = retrieval.build_postings(_docs(spark), fields, KEYS)
    some = retrieval.build_postings(_docs(spark), fields, KEYS, _wanted(spark, 5))
    assert some.where("chapter > 5 or novel = 'm'").count() == 0 and _rows(retrieval.keyword_search(queries, some, ["novel"])) == _rows(retrieval.keyword_search(queries, every, ["novel"]))
    some = retrieval.build_postings(_docs(spark), fields, KEYS, _wanted(spark, None))
    sizes = _docs(spark).select("novel", "item", (F.size(retrieval.terms("title")) + F.size(retrieval.terms("text"))).cast("long").alias("_dl")).where("_dl > 0")
    assert _rows(retrieval.bm25_search(queries, some, ["novel"], sizes=sizes)) == _rows(retrieval.bm25_search(queries, every, ["novel"]))
