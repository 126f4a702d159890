"""An item's words are grouped in its row, and an index is written without dealing its rows."""

import re

from loreframe.functions import text as X
from loreframe.operators import fulltext, retrieval
from loreframe.plans import bind

DOCS = [("n", 1, 1, "Red fox", "the red fox jumps red"), ("n", 2, 2, None, "fox"), ("m", 1, 3, "", None), ("m", 2, 4, "the", "Ünder_1 the Ünder_1"), (None, None, 5, "lost fox", "")]
KEYS = ["novel", "chapter", "item"]


def docs(spark):
    return spark.createDataFrame(DOCS, "novel string, chapter int, item long, title string, body string")


def placed(fields):
    """Term by term in plain Python."""
    out = {}
    for novel, chapter, item, *texts in DOCS:
        place = 0
        for text, weight in zip(texts, fields, strict=True):
            for term in re.findall(r"\w+", (text or "").lower()):
                place += 1
                if term not in X.STOPWORDS:
                    out.setdefault((novel, chapter, item, term, weight), []).append(place)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_are_grouped_in_their_row(spark):
    """every place of every item was shuffled, then its rows again."""
    for classes, weights in (({"title": "A", "body": "D"}, (1.0, 0.1)), ({"title": "B", "body": "B"}, (0.4, 0.4)), ({"title": "D", "body": "A"}, (0.1, 1.0))):
        index = fulltext.positions(docs(spark).repartition(3), classes, KEYS)
        assert {tuple(r)[:5]: r.places for r in index.collect()} == placed(weights)
        assert index.dtypes[-2:] == [("weight", "double"), ("places", "array<int>")]
        postings = retrieval.build_postings(docs(spark), classes, KEYS)
        assert {tuple(r)[:5]: r.tf for r in postings.collect()} == {k: len(v) for k, v in placed(weights).items()}
    assert "Exchange" not in plan(fulltext.positions(docs(spark), {"title": "A", "body": "D"}, KEYS))
    assert "Exchange" not in plan(retrieval.build_postings(docs(spark), {"title": "A", "body": "D"}, KEYS))


def test_no_items(spark):
    assert fulltext.positions(docs(spark).where("item > 9"), {"title": "A", "body": "D"}, KEYS).count() == 0
    assert fulltext.positions(docs(spark).where("item = 3"), {"title": "A", "body": "D"}, KEYS).count() == 0


def test_each_task_adds_to_the_buckets(spark, tmp_path):
    index = fulltext.positions(docs(spark).repartition(4, "item"), {"title": "A", "body": "D"}, KEYS)
    fulltext.write_index(index, f"file://{tmp_path}/i", 4)
    assert {tuple(r)[:5]: r.places for r in spark.read.parquet(f"file://{tmp_path}/i").select(*KEYS, "term", "weight", "places").collect()} == placed((1.0, 0.1))
    files = [p for p in tmp_path.glob("i/*/*.parquet")]
    assert len({p.name.split("-")[1] for p in files}) > 1  # one writer a task


def test_texts_are_dealt_by_their_length(spark, monkeypatch):
    rows = spark.createDataFrame([("abcd" * 10,)] * 20 + [(None,)], "text string")
    assert bind.text_tasks(rows, "text") is None
    monkeypatch.setattr(bind, "TASK_CHARS", 50)
    assert bind.text_tasks(rows, "text") == 16
    assert bind.text_tasks(rows.where("text is null"), "text") is None
