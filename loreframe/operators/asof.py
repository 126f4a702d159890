"""Cutoffs, as-of reads and row-version history.

A chapter number is the only event time. Every operator takes many novels and cutoffs at once and filters by the
cutoff before it ranks or limits anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_cutoff(rows: DataFrame, asked: DataFrame | None = None, novel: str = "novel", chapter: str = "chapter") -> DataFrame:
    """(novel, cutoff, last, uncapped): the asked cutoff, else the last chapter, else 0."""
    last = rows.groupBy(novel).agg(F.coalesce(F.max(chapter), F.lit(0)).alias("last"))
    out = last.withColumn("cutoff", F.col("last")) if asked is None else asked.join(last, novel, "left").withColumn("last", F.coalesce("last", F.lit(0))).withColumn("cutoff", F.coalesce("cutoff", "last"))
    return out.select(novel, "cutoff", "last", (F.col("cutoff") >= F.col("last")).alias("uncapped"))


def masked(end: str | Column, cutoff: str | Column) -> Column:
    """A recorded end shows only where it isn't later than the cutoff."""
    end = F.col(end) if isinstance(end, str) else end
    return F.when(end <= (F.col(cutoff) if isinstance(cutoff, str) else cutoff), end)


def seen_by(first: str, cutoff: str) -> Column:
    """A row without a first appearance is always visible."""
    return F.col(first).isNull() | (F.col(first) <= F.col(cutoff))


def within(since: str, until: str, cutoff: str, *, loses_at_end: bool) -> Column:
    """Whether an interval holds at the cutoff. A possession's end is the chapter of its loss, a location's the last chapter there."""
    end, at = F.col(until), F.col(cutoff)
    return (F.col(since) <= at) & (end.isNull() | ((end > at) if loses_at_end else (end >= at)))


def held_entering(since: str, until: str, chapter: str) -> Column:
    """Whether a possession is held when a chapter begins."""
    return (F.col(since) < F.col(chapter)) & (F.col(until).isNull() | (F.col(until) >= F.col(chapter)))


def latest_before(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key: partial maxima are shuffled, not rows."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def records_at(versions: DataFrame, cutoffs: DataFrame, keys: list[str], payload: str = "payload", chapter: str = "chapter") -> DataFrame:
    """keys, cutoff and the payload of the last version not after each cutoff; a null payload is a tombstone.

    cutoffs has the columns that it shares with versions, and cutoff.
    """
    shared = [c for c in cutoffs.columns if c in versions.columns]
    met = versions.join(F.broadcast(cutoffs), shared) if shared else versions.crossJoin(F.broadcast(cutoffs))
    met = met.where(F.col(chapter) <= F.col("cutoff"))
    return met.groupBy(*keys, "cutoff").agg(F.max_by(payload, chapter).alias(payload)).where(F.col(payload).isNotNull())


def capture_versions(current: DataFrame, previous: DataFrame, keys: list[str], chapter: Column, payload: str = "payload") -> DataFrame:
    """New versions at a chapter: changed or new rows, and tombstones for rows that vanished."""
    now = current.select(*keys, F.col(payload).alias("_now"))
    then = previous.select(*keys, F.col(payload).alias("_then"))
    met = now.join(then, keys, "full_outer").where(~F.col("_now").eqNullSafe(F.col("_then")))
    return met.select(*keys, chapter.alias("chapter"), F.col("_now").alias(payload))


def version_log(rows: DataFrame, keys: list[str], payload: str = "payload", chapter: str = "chapter") -> DataFrame:
    """The versions that capturing after every chapter would write: a row's payload where it differs from its last one.

    rows hold each key's state at the end of the chapters in which it was written; null is a tombstone.
    """
    before = F.lag(payload).over(W.partitionBy(*keys).orderBy(chapter))
    return rows.withColumn("_before", before).where(~F.col(payload).eqNullSafe(F.col("_before"))).drop("_before")


def restore_prefix(versions: DataFrame, chapter: int, baselines: DataFrame, keys: list[str], novel: str = "novel") -> tuple[DataFrame, DataFrame]:
    """(versions up to a chapter, novels refused because their history begins later)."""
    refused = baselines.where(F.col("baseline") > chapter).select(novel)
    kept = versions.where(F.col("chapter") <= chapter).join(refused, novel, "left_anti")
    return kept, refused


def with_history(current: DataFrame, versions: DataFrame, cutoffs: DataFrame, baselines: DataFrame, keys: list[str], novel: str = "novel") -> DataFrame:
    """Records at cutoffs: novels without a baseline read their current rows; a cutoff before the baseline reads none."""
    bare = current.join(baselines.select(novel), novel, "left_anti").join(F.broadcast(cutoffs), novel)
    allowed = cutoffs.join(baselines, novel).where("cutoff >= baseline").drop("baseline")
    return bare.select(*keys, "cutoff", "payload").unionByName(records_at(versions, allowed, keys))


def visible_by_reference(entities: DataFrame, references: DataFrame, cutoffs: DataFrame, entity: str = "entity") -> DataFrame:
    """Entities at cutoffs whose earliest reference isn't later; entities never referenced are visible."""
    first = references.groupBy(entity).agg(F.min("chapter").alias("first"))
    met = entities.join(first, entity, "left").crossJoin(F.broadcast(cutoffs))
    return met.where(F.coalesce("first", F.lit(0)) <= F.col("cutoff"))


def unsuperseded(rows: DataFrame, cutoffs: DataFrame, row_id: str, successor: str, start: Column) -> DataFrame:
    """Rows at cutoffs whose successor hasn't started.

    A row learns once when its successor starts, before it meets the cutoffs. Rows without a successor, which are most, are dealt by
    their own id: by the null key they would all come into one task. The other side is as long as the table, so it isn't broadcast.
    """
    newer = rows.select(F.col(row_id).alias("_newer"), start.alias("_start")).groupBy("_newer").agg(F.min("_start").alias("_start")).withColumn("_dealt", F.xxhash64("_newer"))
    dealt = F.xxhash64(F.coalesce(successor, row_id))
    met = rows.withColumn("_own", dealt).join(newer.hint("merge"), (F.col(successor) == F.col("_newer")) & (F.col("_own") == F.col("_dealt")), "left").drop("_own", "_newer", "_dealt")
    return met.crossJoin(F.broadcast(cutoffs)).where(F.col("_start").isNull() | (F.col("_start") > F.col("cutoff"))).drop("_start")


def topk(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
