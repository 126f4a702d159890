"""N-gram Jaccard join: prefix trees over globally ordered shingle sets.

Documents whose sets of distinct 5-word shingles have a Jaccard similarity of ``percent`` or more are linked,
and the components of the links are found without listing the pairs of a group (see ``setjoin``).

Cases: null and empty texts have no shingles and are linked with nothing; fewer words than a shingle make one
shingle; texts differing only in A-Z case or ASCII white space are equal; repeated rows each get a row; a row
without an id links like others and never names a component; empty tables give empty results; extra columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreframe.llm import setjoin
from loreframe.llm.shared import hot_join, hot_keys, shingle_sets, stored

PERCENT, SHINGLE = 75, 5


def _documents(size: int, names: list[str]) -> setjoin.Sets:
    def sets(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        for i, tokens, cuts in shingle_sets(batch.column("text"), size):
            yield [batch.column(c).slice(i, len(cuts) - 1) for c in names], tokens, cuts

    return sets


def _joined(rows: DataFrame, names: list[str], first: Column, percent: int, shingle: int) -> DataFrame:
    """names, n, cls (null without words) and component: the least ``first`` of the rows that links reach."""
    sets = _documents(shingle, names)
    entities, counts = setjoin.members(rows, sets, names)
    roots = setjoin.linked(setjoin.survivors(rows, sets, entities, counts, percent), percent)
    classes = stored(entities.where("cls is not null").groupBy("cls").agg(F.min(first).alias("first"), F.count("*").alias("held")), "classes")
    named = stored(classes.select("cls", "first").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "named")
    least = stored(named.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("held")), "least")
    named = hot_join(named, least.drop("held"), "root", hot_keys(least, "root", "held"), "cls").select("cls", "component")
    return hot_join(entities, named, "cls", hot_keys(classes, "cls", "held"), names[-1])


def ngram_join(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = _joined(rows, ["id"], F.col("id"), percent, shingle)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: that with the smallest id, rows without an id last.

    Rows are known by a 128-bit digest of their id and text, so that different texts under one id are judged each for
    itself, and rows without an id too. Of rows equal in both, texts without words included, one stays.
    """
    key = lambda seed: F.xxhash64(F.lit(seed), F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col)
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key(1).alias("k1"), key(2).alias("k2"))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("k1"), F.col("k2"))
    found = _joined(keyed.select("id", "k1", "k2", "text"), ["id", "k1", "k2"], own, percent, shingle)
    other = (F.col("k1") != F.col("component.k1")) | (F.col("k2") != F.col("component.k2"))
    gone = stored(found.where(F.col("cls").isNotNull() & other).select("k1", "k2").distinct(), "near-copies")
    left = keyed.select("_row", "k1", "k2").join(gone, ["k1", "k2"], "left_anti")
    twice = stored(left.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "repeated")
    if twice.isEmpty():
        return left.select("_row.*")
    # a hot group of equal rows is reduced before it is shuffled
    again = left.join(twice, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return left.join(twice, ["k1", "k2"], "left_anti").unionByName(again.select("_row", "k1", "k2")).select("_row.*")
