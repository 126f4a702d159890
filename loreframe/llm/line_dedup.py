"""Line dedup by an exact set-similarity join.

A line's tokens are its 5-word shingles (a line of fewer words has one). Two lines match where the Jaccard
similarity of their token sets is ``percent`` or more. Tokens are ordered by rarity; the join counts, prefixes,
bounds by length and by position on the way down a prefix tree, and verifies exactly (see ``setjoin``). A line
is removed where it matches any line before it, in order of document id and line number, whether or not that
one is removed itself.

Cases: lines are what newline characters separate; null texts have none, empty texts one empty line; lines
without words match nothing and stay; documents without an id are kept whole and not compared; repeated rows of
one id are one document, whose equal lines count as one; empty tables give empty results; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreframe.llm import setjoin
from loreframe.llm.shared import Words, grouped_sets, hot_join, hot_keys, pieces, stored, utf8

PERCENT, SHINGLE = 75, 5


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, offsets) of every line of some rows; a line ends with its newline."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + 1 + offsets[0]
    rows = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks - 1, side="right") - 1])
    begins = np.concatenate([offsets[:-1], breaks])
    order = np.lexsort((begins, rows))
    rows, begins = rows[order], begins[order]
    first = np.searchsorted(rows, np.arange(n))
    return rows, np.arange(len(rows)) - first[rows], np.append(begins, offsets[-1])


def _lines(size: int) -> setjoin.Sets:
    def sets(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        ids = batch.column("id")
        data, offsets = utf8(batch.column("text"))
        for i, j in pieces(offsets):
            rows, numbers, bounds = lines_of(data, offsets[i : j + 1])
            hashes, at, _ = Words(data, bounds).shingles(size)
            yield [pc.take(ids, pa.array(rows + i)), numbers], *grouped_sets(hashes, at, len(rows))

    return sets


def matched_lines(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, n, removed) of every line of the documents with an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sets = _lines(shingle)
    entities, counts = setjoin.members(rows, sets, ["id", "line"])
    places = entities.where("cls is not null").groupBy("cls").agg(F.min(F.struct("id", "line")).alias("p"), F.count("*").alias("held"))
    places = stored(places.select("cls", F.col("p.id").alias("p1"), F.col("p.line").alias("p2"), "held"), "places")
    alive = setjoin.survivors(rows, sets, entities, counts, percent)
    gone = setjoin.shadowed(alive, places.drop("held"), percent).withColumn("gone", F.lit(True))
    known = places.drop("held").join(gone, "cls", "left")
    later = (F.col("p1") < F.col("id")) | ((F.col("p1") == F.col("id")) & (F.col("p2") < F.col("line")))
    out = hot_join(entities, known, "cls", hot_keys(places, "cls", "held"), "id")
    return out.select("id", "line", "n", F.coalesce(F.col("gone") | later, F.lit(False)).alias("removed"))


def line_dedup(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, removed: the numbers of the removed lines) of each document with an id and a text."""
    found = matched_lines(docs, percent, shingle, id_col, text_col)
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    twice = stored(ids.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if not twice.isEmpty():  # lines are made distinct for the repeated ids alone
        found = found.join(twice, "id", "left_anti").unionByName(found.join(twice, "id", "left_semi").distinct())
    out = found.groupBy("id").agg(F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed"))
    return out.withColumnRenamed("id", id_col)


def without_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose texts lack the removed lines."""
    row, gone = F.struct(*docs.columns).alias("row"), found.where("n_removed > 0").select(F.col(id_col).alias("id"), "removed")
    lines = F.split(f"row.`{text_col}`", "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed", i.cast("long"))), "\n")
    met = docs.select(row, F.col(id_col).alias("id")).join(gone, "id", "left")
    text = F.when(F.col("removed").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept)
    return met.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
