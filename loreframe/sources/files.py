"""Files in and out: tables, chapter texts, and derived tables written by partition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; where none is set, one of our own in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, novels: list | None = None, cutoff: int | None = None) -> DataFrame:
    """A table with its novel and chapter predicates, which reach the scan."""
    rows = spark.read.parquet(path)
    if novels is not None:
        rows = rows.where(F.col("novel").isin(novels))
    return rows if cutoff is None else rows.where(F.col("chapter") <= cutoff)


def read_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(number, text) of a folder of chNN.txt files; other files are left out."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^ch(\d+)\.txt$", 1).alias("_n"), F.col("value").alias("text"))
    return rows.where("_n <> ''").select(F.col("_n").cast("int").alias("number"), "text")


def write_chapters(chapters: DataFrame, folder: str) -> None:
    """One folder by novel of chapters as Parquet, in order of their number; novels are dealt by ranges of it, so that a long one is several files."""
    chapters.repartitionByRange("novel", "number").sortWithinPartitions("novel", "number").write.mode("overwrite").partitionBy("novel").parquet(folder)


def append_chapters(chapters: DataFrame, folder: str) -> DataFrame:
    """Add chapters (novel, number, ...) to a folder of write_chapters; gives the rejected ones: numbers that are there, or that come twice.

    Which are there is read from the folders of the novels that are added to alone (a join prunes the partitions).
    """
    from pyspark.sql import Window as W

    spark = chapters.sparkSession
    there = spark.read.parquet(folder).select("novel", "number").join(chapters.select("novel").distinct(), "novel", "left_semi")
    order = W.partitionBy("novel", "number").orderBy(*[F.hash(c) if t.startswith("map") else F.col(c) for c, t in chapters.dtypes if c not in ("novel", "number")])
    marked = chapters.withColumn("_n", F.row_number().over(order)).join(there.withColumn("_there", F.lit(True)), ["novel", "number"], "left")
    marked = stored(marked, "chapters-to-append")
    fresh = (F.col("_n") == 1) & F.col("_there").isNull()
    marked.where(fresh).select(*chapters.columns).repartitionByRange("novel", "number").sortWithinPartitions("novel", "number").write.mode("append").partitionBy("novel").parquet(folder)
    return marked.where(~fresh).select(*chapters.columns)


def write_projection(rows: DataFrame, path: str, buckets: int = 16, novel: str = "novel") -> None:
    """Replace whole novels of a derived table: only the hash buckets that rows touch are written anew.

    rows must hold every row of the novels in the buckets they touch, as a recomputed projection does. A large bucket is
    written by several tasks.
    """
    out = rows.withColumn("novel_bucket", F.pmod(F.xxhash64(novel), F.lit(buckets)))
    out.repartitionByRange("novel_bucket", *[c for c in rows.columns[:2]]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("novel_bucket").parquet(path)
