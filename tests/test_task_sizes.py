"""What one task holds: rows without a key are spread, and tables are dealt by their number."""

import pytest
from pyspark.sql import functions as F

from loreframe.operators import asof
from loreframe.plans import bind


@pytest.fixture
def shuffled(spark):
    """Joins as they are on tables beyond a broadcast."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_rows_without_a_successor_are_not_one_task(shuffled):
    """F16: the null key of the join was one task."""
    rows = shuffled.range(1000).select("id", F.when(F.col("id") % 100 == 0, F.col("id") + 1).alias("successor"), (F.col("id") % 20).cast("int").alias("start"))
    cutoffs = shuffled.createDataFrame([(5,), (10,)], "cutoff int")
    live = asof.unsuperseded(rows, cutoffs, "id", "successor", F.col("start"))
    assert live.columns == ["id", "successor", "start", "cutoff"]
    # 10 rows have a successor, which starts at 1, before both cutoffs
    assert live.count() == 990 * 2
    sizes = [r.n for r in live.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("successor").isNull()).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 1000


def test_a_successor_counts_from_its_start(spark):
    rows = spark.createDataFrame([(1, 2, 1), (2, 3, 7), (3, None, None), (4, 99, 2)], "id long, successor long, start int")
    live = asof.unsuperseded(rows, spark.createDataFrame([(5,), (10,)], "cutoff int"), "id", "successor", F.col("start"))
    assert sorted((r.id, r.cutoff) for r in live.collect()) == [(1, 5), (2, 5), (2, 10), (3, 5), (3, 10), (4, 5), (4, 10)]


def test_tables_are_dealt_by_their_number(spark, monkeypatch):
    """a task's rows grew with the table."""
    monkeypatch.setattr(bind, "TASK_ROWS", 50)
    assert bind.dealt(spark.range(1000), "id").rdd.getNumPartitions() == 20
    assert bind.dealt(spark.range(10), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
