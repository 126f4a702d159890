"""Folds of an append-only log into validity intervals, snapshots and knowledge.

Logs are ordered by (chapter, ordinal) within an entity. All folds partition by entity, never by novel alone, and
are windows, grouped aggregates or, for relationships, a sorted stream with bounded state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ["chapter", "ordinal"]
CARRIED = ("location", "goals", "physical_state", "appearance")
NOT_CARRIED = ("emotional_state", "notes")


def state_events(deltas: DataFrame, assertions: DataFrame) -> DataFrame:
    """(novel, entity, chapter, phase, ordinal, kind, value): deltas, then learnings, then expirations.

    assertions: novel, entity, id, text, learned, successor. A fact expires in the chapter in which its
    replacement is learnt, if that one is in the log.
    """
    newer = assertions.select(F.col("id").alias("successor"), F.col("learned").alias("expires"))
    learnt = assertions.select("novel", "entity", F.col("learned").alias("chapter"), F.lit(1).alias("phase"), F.col("id").alias("ordinal"), F.lit("learn").alias("kind"), F.col("text").alias("value"))
    gone = assertions.join(newer, "successor").select("novel", "entity", F.col("expires").alias("chapter"), F.lit(2).alias("phase"), F.col("id").alias("ordinal"), F.lit("expire").alias("kind"), F.col("text").alias("value"))
    own = deltas.select("novel", "entity", "chapter", F.lit(0).alias("phase"), "ordinal", "kind", "value")
    return own.unionByName(learnt).unionByName(gone)


def location_edges(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, location, since, until, superseded_by): consecutive equal locations are one interval.

    An interval ends in the chapter before the next one starts, and never before it started itself.
    """
    keys = keys or ["novel", "entity"]
    order = W.partitionBy(*keys).orderBy(*ORDER)
    moved = log.withColumn("_before", F.lag("location").over(order)).where(~F.col("location").eqNullSafe(F.col("_before")))
    nxt = F.lead("chapter").over(order)
    until = F.when(nxt.isNotNull(), F.greatest(nxt - 1, F.col("chapter")))
    return moved.select(*keys, F.col("ordinal").alias("id"), "location", F.col("chapter").alias("since"), until.alias("until"), F.lead("ordinal").over(order).alias("superseded_by"))


def located(edges: DataFrame, cutoffs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Location intervals at cutoffs: those that hold, and of several of a chapter the last. edges: keys, id, since, until.

    An entity's next interval replaces it from its start on, also where both are of one chapter; the start is known from the
    window by entity that made the intervals, so that no join of the intervals with themselves is needed.
    """
    keys = keys or ["novel", "entity"]
    nxt = F.lead("since").over(W.partitionBy(*keys).orderBy("since", "id"))
    met = edges.withColumn("_next", nxt).crossJoin(F.broadcast(cutoffs)).where((F.col("since") <= F.col("cutoff")) & (F.col("until").isNull() | (F.col("until") >= F.col("cutoff"))))
    return met.where(F.col("_next").isNull() | (F.col("_next") > F.col("cutoff"))).drop("_next")


def possession_edges(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, since, until) from changes gain and loss: repeated gains, and losses of what isn't held, do nothing."""
    keys = keys or ["novel", "entity", "object"]
    order = W.partitionBy(*keys).orderBy(*ORDER)
    turns = log.withColumn("_before", F.coalesce(F.lag("change").over(order), F.lit("loss"))).where("change <> _before")
    turns = turns.withColumn("until", F.lead("chapter").over(order)).where("change = 'gain'")
    return turns.select(*keys, F.col("ordinal").alias("id"), F.col("chapter").alias("since"), "until")


def state_snapshots(log: DataFrame, keys: list[str] | None = None, extra: DataFrame | None = None) -> DataFrame:
    """(keys, chapter, attributes): a row for each chapter in which something happened to an entity.

    log: keys, chapter, ordinal, attribute, value. The last value of a chapter counts; the carried attributes
    keep their last value, emotional_state and notes are the chapter's own. extra adds chapters (keys, chapter).
    """
    keys = keys or ["novel", "entity"]
    point = [*keys, "chapter"]
    last = [F.max_by(F.when(F.col("attribute") == a, F.col("value")), F.when(F.col("attribute") == a, F.col("ordinal"))).alias(a) for a in (*CARRIED, *NOT_CARRIED)]
    rows = log.groupBy(*point).agg(*last)
    if extra is not None:
        rows = rows.join(extra.select(*point).distinct(), point, "full_outer")
    order = W.partitionBy(*keys).orderBy("chapter").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select(*point, *[F.last(a, ignorenulls=True).over(order).alias(a) for a in CARRIED], *NOT_CARRIED)


def expiries(assertions: DataFrame) -> DataFrame:
    """assertions with expires: the chapter in which the successor was learnt."""
    newer = assertions.select(F.col("id").alias("successor"), F.col("learned").alias("expires"))
    return assertions.join(newer, "successor", "left")


def knowledge_sets(assertions: DataFrame, points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, chapter, knowledge): what is known at each point, distinct by text, in order of first learning."""
    keys = keys or ["novel", "entity"]
    known = expiries(assertions)
    met = points.select(*keys, "chapter").distinct().join(known, keys).where("learned <= chapter and (expires is null or expires > chapter)")
    first = met.groupBy(*keys, "chapter", "text").agg(F.min(F.struct("learned", "id")).alias("_at"))
    own = first.groupBy(*keys, "chapter").agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_all"))
    return own.select(*keys, "chapter", F.transform("_all", lambda x: x["text"]).alias("knowledge"))


def assemble_history(edges: DataFrame, chapters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, chapter, location): the interval that holds in each chapter; of several, the latest."""
    keys = keys or ["novel", "entity"]
    met = chapters.join(edges, keys).where("since <= chapter and (until is null or until >= chapter)")
    return met.groupBy(*keys, "chapter").agg(F.max_by("location", F.struct("since", "id")).alias("location"))


def fold_threads(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, description, opened, closed) from updates (keys, chapter, ordinal, status, description).

    The last status wins, an unknown one is progressing; a closing chapter remains only while closed.
    """
    status = F.when(F.col("status").isin("open", "progressing", "closed"), F.col("status")).otherwise("progressing")
    order = F.struct(*ORDER)
    rows = log.withColumn("_status", status)
    out = rows.groupBy(*keys).agg(
        F.max_by(F.struct("_status", "chapter"), order).alias("_last"),
        F.max_by("description", F.when(F.col("description").isNotNull(), order)).alias("description"),
        F.min("chapter").alias("opened"),
    )
    return out.select(*keys, F.col("_last._status").alias("status"), "description", "opened", F.when(F.col("_last._status") == "closed", F.col("_last.chapter")).alias("closed"))


def _canon_claims(log: DataFrame, keys: list[str], locked: DataFrame | None, corrections: DataFrame | None) -> DataFrame:
    """Claims and corrections with confidence, lock_seq, manual, and open: whether the fold may take them."""
    confidence = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))
    rows = log.select(*keys, "seq", "value", confidence.alias("confidence"), F.lit(False).alias("manual"))
    if corrections is not None:
        rows = rows.unionByName(corrections.select(*keys, "seq", "value", F.lit(1.0).alias("confidence"), F.lit(True).alias("manual")))
    rows = rows.withColumn("lock_seq", F.lit(None).cast("long")) if locked is None else rows.join(locked, keys, "left")
    return rows.withColumn("open", F.col("manual") | F.col("lock_seq").isNull() | (F.col("seq") <= F.col("lock_seq")))


def fold_canon(log: DataFrame, keys: list[str], locked: DataFrame | None = None, corrections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, contradictions) from claims (keys, seq, value, confidence); locked: keys, lock_seq; corrections: keys, seq, value.

    A claim replaces the value where its confidence (0 or absent counts as 1, within 0 and 1) is at least the
    current one; accepted confidence never falls, so the result is the claim with the highest (confidence, seq).
    After a key is locked its value stays, and claims of another value are contradictions. A correction by hand has
    confidence 1, so it replaces any value, and a lock doesn't stop it.
    """
    rows = _canon_claims(log, keys, locked, corrections)
    facts = rows.where("open").groupBy(*keys).agg(F.max_by(F.struct("value", "confidence", "seq"), F.struct("confidence", "seq")).alias("_f"), F.max("lock_seq").isNotNull().alias("locked"))
    facts = facts.select(*keys, "_f.value", "_f.confidence", "_f.seq", "locked")
    later = rows.where("not open").join(facts.where("locked").select(*keys, F.col("value").alias("canon")), keys).where("value <> canon")
    return facts, later.select(*keys, "seq", "value", "canon")


def canon_before(log: DataFrame, points: DataFrame, keys: list[str], locked: DataFrame | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """(keys, chapter, value, locked): the canon of each point (keys, chapter) as it was before that chapter, where there was any.

    Claims and points of a key run through one window, in which the running maximum of (confidence, seq) is the fold.
    """
    claims = _canon_claims(log, keys, locked, corrections).where("open")
    best = F.struct("confidence", "seq", "value")
    both = claims.select(*keys, F.col("seq").alias("chapter"), F.lit(1).alias("_kind"), best.alias("_best"), "lock_seq")
    both = both.unionByName(points.select(*keys, F.col("chapter").cast("long").alias("chapter")).distinct().withColumns({"_kind": F.lit(0), "_best": F.lit(None).cast(both.schema["_best"].dataType), "lock_seq": F.lit(None).cast("long")}))
    before = W.partitionBy(*keys).orderBy("chapter", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = both.withColumns({"_best": F.max("_best").over(before), "_lock": F.max("lock_seq").over(before)})
    return run.where("_kind = 0 and _best is not null").select(*keys, "chapter", F.col("_best.value").alias("value"), F.coalesce(F.col("_lock") < F.col("chapter"), F.lit(False)).alias("locked"))


_KEPT = "novel {novel}, rel_type {rel_type}, seq bigint, a bigint, b bigint, mutual boolean, from_chapter int, to_chapter int, notes string, superseded_by bigint"


def _relationships() -> Callable:
    """Rows in order of pair and seq: each pair's active rows are held, one for each direction at most; a row is put out once it can't change."""
    names = [c.split()[0] for c in _KEPT.split(", ")]

    def step(active: list[dict], row: dict) -> Iterator[dict]:
        match = [k for k in active if (k["a"], k["b"]) == (row["a"], row["b"]) or (k["mutual"] and row["mutual"])]
        if match:
            if row["to_chapter"] is None or any(k["to_chapter"] is not None for k in match):
                return
            first = match[0]
            row["from_chapter"] = row["from_chapter"] if first["from_chapter"] is None else first["from_chapter"]
            row["notes"] = first["notes"] if row["notes"] is None else row["notes"]
            for k in match:
                yield k | {"superseded_by": row["seq"]}
                active.remove(k)
        active.append(row)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, pair, active = None, None, []
        for batch in batches:
            schema, out = pa.schema([f if f.name != "superseded_by" else pa.field("superseded_by", pa.int64()) for f in batch.select(names).schema]), []
            for row in batch.to_pylist():
                own = row.pop("_pair")
                if own != pair:
                    out += active
                    pair, active = own, []
                out += step(active, row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if schema is not None:
            yield pa.RecordBatch.from_pylist(active, schema)

    return go


def fold_relationships(log: DataFrame) -> DataFrame:
    """Relationship rows kept from assertions (novel, a, b, rel_type, mutual, from_chapter, to_chapter, notes, seq).

    Within an unordered pair and type, in order of seq: an assertion with the same direction (or both mutual) as
    the active row is a duplicate unless it states an end that the row hasn't; then the row is superseded by a new
    one that inherits its start and notes. Pairs are sorted and streamed: a task holds a pair's active rows, of which
    there are two at most, however often the pair is asserted.
    """
    types = dict(log.dtypes)
    pair = F.struct("novel", "rel_type", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    fields = ["novel", "rel_type", F.col("seq").cast("long").alias("seq"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "mutual", F.col("from_chapter").cast("int").alias("from_chapter"), F.col("to_chapter").cast("int").alias("to_chapter"), "notes"]
    rows = log.select(*fields, F.lit(None).cast("long").alias("superseded_by"), F.to_json(pair).alias("_pair"))
    dealt = rows.repartition("_pair").sortWithinPartitions("_pair", "seq")
    return dealt.mapInArrow(_relationships(), _KEPT.format(novel=types["novel"], rel_type=types["rel_type"]))


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
