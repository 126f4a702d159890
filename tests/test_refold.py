"""Refolding the end of a log equals folding it whole; stored tables change in touched buckets alone; streams of shuffled triggers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreframe.operators import folds, refold
from loreframe.streaming import edges

LOG = "novel long, entity long, chapter int, ordinal long, location string, object long, change string, attribute string, value string"


def random_log(rng, n, entities=12):
    out = []
    for i in range(n):
        change = [None, "gain", "loss"][rng.integers(0, 3)]
        out.append((int(rng.integers(0, 3)), int(rng.integers(0, entities)), int(rng.integers(1, 15)), i, "abc"[rng.integers(0, 3)], int(rng.integers(0, 3)), change, ("goals", "notes", "appearance", "location")[rng.integers(0, 4)], str(i % 7)))
    return out


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_refold_equals_full_fold(spark, seed, tmp_path):
    rng = np.random.default_rng(seed)
    points = {0: int(rng.integers(1, 16)), 2: int(rng.integers(1, 16))}
    old = random_log(rng, 260)
    kept = [r for r in old if not (r[0] in points and r[2] >= points[r[0]] and rng.random() < 0.5)]
    more = [(k, int(rng.integers(0, 14)), int(rng.integers(p, 18)), 1000 + 10 * k + i, "xyz"[i % 3], 1, ["gain", "loss"][i % 2], "goals", f"new{i}") for k, p in points.items() for i in range(int(rng.integers(0, 6)))]
    old, new = spark.createDataFrame(old, LOG), spark.createDataFrame(kept + more, LOG)
    at = spark.createDataFrame(list(points.items()), "novel long, from_chapter int")
    entities = refold.touched(old, new, at)
    late = refold.suffix(new, entities)
    gains = lambda log: folds.possession_edges(log.where("change is not null"))
    for name, make, fold in (("l", folds.location_edges, refold.refold_locations), ("p", gains, refold.refold_possessions), ("s", folds.state_snapshots, refold.refold_snapshots)):
        whole = make(new)
        assert held(fold(make(old), late, entities)) == held(whole)
        path = f"{tmp_path}/{name}"
        refold.write_table(make(old), f"file://{path}", 16)
        before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
        wanted = refold.refold_table(f"file://{path}", fold, late, entities, 16)
        assert held(spark.read.parquet(f"file://{path}").select(*whole.columns)) == held(whole)
        after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
        assert all(after.get(d) == files for d, files in before.items() if int(d.split("=")[1]) not in wanted)


def test_only_touched_buckets_are_read(spark, tmp_path):
    log = spark.createDataFrame(random_log(np.random.default_rng(9), 200), LOG)
    path = f"file://{tmp_path}/t"
    refold.write_table(folds.location_edges(log), path, 16)
    one = spark.createDataFrame([(1, 3, 5)], "novel long, entity long, from_chapter int")
    wanted = refold.touched_buckets(one, 16)
    assert len(wanted) == 1
    plan = refold.read_buckets(spark, path, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or f"bucket#" in plan and f"= {wanted[0]})" in plan


def test_entities_that_lose_all_rows(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, 5, 0, "a", None, None, "goals", "x"), (1, 2, 1, 1, "b", None, None, "goals", "y")], LOG)
    new, at = old.where("entity = 2"), spark.createDataFrame([(1, 3)], "novel long, from_chapter int")
    entities = refold.touched(old, new, at)
    path = f"file://{tmp_path}/t"
    refold.write_table(folds.location_edges(old), path, 64)
    refold.refold_table(path, refold.refold_locations, refold.suffix(new, entities), entities, 64)
    assert [r.entity for r in spark.read.parquet(path).collect()] == [2]


def test_unknown_ids_are_counted(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 9, "a"), (2, 1, "b")], "novel long, entity long, location string")
    ids = {"entity": spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "novel long, entity long"), "location": spark.createDataFrame([(1, "a")], "novel long, location string")}
    kept, skipped = refold.resolved(log, ids)
    assert held(kept) == [(1, 1, "a"), (1, 2, None)] and held(skipped) == [(1, 1), (2, 1)]


def test_rewound_supersession(spark):
    rows = spark.createDataFrame([(1, 10, 2, 11), (1, 11, 6, None), (1, 12, 3, 13), (1, 13, 4, None), (2, 14, 9, None)], "novel long, id long, learned int, successor long")
    got = refold.rewound_records(rows, spark.createDataFrame([(1, 5)], "novel long, from_chapter int"), "learned")
    assert held(got) == [(1, 10, 2, None), (1, 12, 3, 13), (1, 13, 4, None), (2, 14, 9, None)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, tmp_path, shuffled):
    """Rows in order give the batch's closed intervals; of shuffled triggers, late entities are refolded from their first late chapter."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", edges.ROCKS)
    rng = np.random.default_rng(11)
    log = sorted(random_log(rng, 150, 6), key=lambda r: (r[2], r[3]))
    if shuffled:
        for i in (10, 30, 60, 80):
            log[i], log[i + 45] = log[i + 45], log[i]
    for k in range(3):
        spark.createDataFrame(log[50 * k : 50 * k + 50], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = edges.stream_edges(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    whole = spark.createDataFrame(log, LOG)
    late = edges.late_points(out).cache()
    assert (late.count() > 0) == shuffled
    fine = lambda df: held(df.join(late, ["novel", "entity"], "left_anti"))
    places, things = folds.location_edges(whole), folds.possession_edges(whole.where("change is not null"))
    assert fine(out.where("kind = 'location'").select("novel", "entity", "id", "location", "since", "until")) == fine(places.where("until is not null").drop("superseded_by"))
    assert fine(out.where("kind = 'possession'").select("novel", "entity", "object", "id", "since", "until")) == fine(things.where("until is not null"))
    # what the stream saw of late entities before their point is the state that the refold goes on from
    suffix = refold.suffix(whole, late)
    before = whole.join(late, ["novel", "entity"], "left").where("from_chapter is null or chapter < from_chapter").drop("from_chapter")
    assert held(refold.refold_locations(folds.location_edges(before), suffix, late)) == held(places)
    assert held(refold.refold_possessions(folds.possession_edges(before.where("change is not null")), suffix, late)) == held(things)
