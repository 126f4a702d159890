"""Rewinding and refolding the end of a log.

After a rewind of novels to chapters (points: novel, from_chapter) the derived tables need not be folded anew from their first
chapter. The rows they had before the point are the state at its mark: an entity's last interval, what it held, its last
snapshot. Only entities that have changes from the point on, in the old log or the new one, are folded, from that state and the
new changes; all other rows stay as they are. Stored derived tables lie in buckets of entities, so that a refold reads
and writes the touched buckets alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.operators import folds
from loreframe.sources.files import stored

ENTITY = ["novel", "entity"]
BUCKETS = 64


def resolved(log: DataFrame, ids: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(log of the rows whose ids all resolve, (novel, n_skipped) of the others).

    ids: column -> known values, in a column of that name with novel; a null id needs no match.
    """
    rows = log
    for c, known in ids.items():
        rows = rows.join(known.select("novel", c).distinct().withColumn(f"_{c}", F.lit(True)), ["novel", c], "left")
    missing = F.lit(False)
    for c in ids:
        missing = missing | (F.col(c).isNotNull() & F.col(f"_{c}").isNull())
    rows = rows.withColumn("_missing", missing).drop(*[f"_{c}" for c in ids])
    return rows.where("not _missing").select(*log.columns), rows.where("_missing").groupBy("novel").agg(F.count("*").alias("n_skipped"))


def rewound_records(rows: DataFrame, points: DataFrame, chapter: str, id_: str = "id", successor: str = "successor") -> DataFrame:
    """Records of before the points: later ones are dropped, and a record that one of these superseded is current again."""
    met = rows.join(points, "novel", "left")
    late = F.coalesce(F.col(chapter) >= F.col("from_chapter"), F.lit(False))
    gone = met.where(late).select("novel", F.col(id_).alias(successor)).withColumn("_gone", F.lit(True))
    kept = met.where(~late).drop("from_chapter").join(gone, ["novel", successor], "left")
    return kept.withColumn(successor, F.when(F.col("_gone").isNull(), F.col(successor))).select(*rows.columns)


def touched(old: DataFrame, new: DataFrame, points: DataFrame) -> DataFrame:
    """(novel, entity, from_chapter) of the entities that either log changes from the points on."""
    each = [log.select(*ENTITY, "chapter").join(points, "novel").where("chapter >= from_chapter").select(*ENTITY, "from_chapter") for log in (old, new)]
    return each[0].union(each[1]).distinct()


def suffix(log: DataFrame, entities: DataFrame) -> DataFrame:
    """The log's rows of the touched entities from their points on."""
    return log.join(entities, ENTITY).where("chapter >= from_chapter").drop("from_chapter")


def _parted(table: DataFrame, entities: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
    """(rows of entities that aren't touched, rows of touched ones that start before their point, with from_chapter)."""
    met = table.join(entities, ENTITY, "left")
    return met.where("from_chapter is null").drop("from_chapter"), met.where(F.col(start) < F.col("from_chapter"))


def refold_locations(edges: DataFrame, late: DataFrame, entities: DataFrame) -> DataFrame:
    """Location intervals after a rewind; late: suffix(...) of the new log."""
    rest, own = _parted(edges, entities, "since")
    last = W.partitionBy(*ENTITY).orderBy(F.desc("since"), F.desc("id"))
    own = own.withColumn("_n", F.row_number().over(last))
    seed = own.where("_n = 1").select(*ENTITY, F.col("since").alias("chapter"), F.col("id").alias("ordinal"), "location")
    fresh = folds.location_edges(seed.unionByName(late.select(*ENTITY, "chapter", "ordinal", "location")))
    return rest.unionByName(own.where("_n > 1").select(*edges.columns)).unionByName(fresh.select(*edges.columns))


def refold_possessions(edges: DataFrame, late: DataFrame, entities: DataFrame) -> DataFrame:
    """Possession intervals after a rewind: those that were open at the point go on from their gain."""
    rest, own = _parted(edges, entities, "since")
    own = own.withColumn("_open", F.col("until").isNull() | (F.col("until") >= F.col("from_chapter")))
    seed = own.where("_open").select(*ENTITY, "object", F.col("since").alias("chapter"), F.col("id").alias("ordinal"), F.lit("gain").alias("change"))
    log = late.where("change is not null").select(*ENTITY, "object", "chapter", "ordinal", "change")
    fresh = folds.possession_edges(seed.unionByName(log), [*ENTITY, "object"])
    return rest.unionByName(own.where("not _open").select(*edges.columns)).unionByName(fresh.select(*edges.columns))


def refold_snapshots(snapshots: DataFrame, late: DataFrame, entities: DataFrame) -> DataFrame:
    """Snapshots after a rewind: carried attributes go on from the last snapshot before the point. late: keys, chapter, ordinal, attribute, value."""
    rest, own = _parted(snapshots, entities, "chapter")
    own = own.drop("from_chapter")
    last = own.groupBy(*ENTITY).agg(F.max_by(F.struct("chapter", *folds.CARRIED), "chapter").alias("_s"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"_s.{a}").alias("value")) for a in folds.CARRIED]))
    seed = last.select(*ENTITY, F.col("_s.chapter").alias("chapter"), F.lit(-1).cast("long").alias("ordinal"), pairs.alias("p")).select(*ENTITY, "chapter", "ordinal", "p.*").where("value is not null")
    fresh = folds.state_snapshots(seed.unionByName(late.select(*ENTITY, "chapter", F.col("ordinal").cast("long").alias("ordinal"), "attribute", "value")))
    fresh = fresh.join(entities, ENTITY).where("chapter >= from_chapter").drop("from_chapter")
    return rest.unionByName(own).unionByName(fresh.select(*snapshots.columns))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*ENTITY), F.lit(buckets)).cast("int")


def write_table(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A derived table in folders by bucket of the entity; what is written replaces the buckets that it has rows in.

    A bucket is written by several tasks where it is large: rows are dealt by range of the entity, not by bucket alone.
    """
    dealt = rows.withColumn("bucket", _bucket(buckets)).repartitionByRange("bucket", *ENTITY)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def touched_buckets(entities: DataFrame, buckets: int = BUCKETS) -> list[int]:
    return sorted(r.b for r in entities.select(_bucket(buckets).alias("b")).distinct().collect())


def read_buckets(spark, path: str, wanted: list[int]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted)).drop("bucket")


def refold_table(path: str, fold, late: DataFrame, entities: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Refold a stored table in place with one of the functions above; gives the buckets that were read and replaced.

    The new rows are written beside the table first, since its folders are read while they are made. A bucket whose rows
    are all gone is replaced by nothing: its entities keep no row before the point, so their rows are dropped by a marker.
    """
    spark, wanted = entities.sparkSession, touched_buckets(entities, buckets)
    if wanted:
        own = read_buckets(spark, path, wanted)
        fresh = stored(fold(own, late, entities), "refolded")
        write_table(fresh, path, buckets)
        full = {r.b for r in fresh.select(_bucket(buckets).alias("b")).distinct().collect()}
        for b in set(wanted) - full:  # at most ``buckets`` folders
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return wanted
