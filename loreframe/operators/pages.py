"""Reader's pages at cutoffs: the timeline with the names of the time, and whole pages of characters and things.

A page is one row an entity and cutoff; its lists are what is known of that entity, each in its order. Lists are aggregated from
the tables by entity and joined at the end, so that no list meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreframe.operators import asof, folds, reads

AT = ["novel", "cutoff"]


def _ordered(order: list[str | Column], value: Column) -> Column:
    """Distinct values in order."""
    own = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = F.array_sort(F.collect_set(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(own)], value.alias("v"))))
    return F.array_distinct(F.transform(rows, lambda x: x["v"]))


def named_at(rows: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
    """rows (novel, cutoff, column) with the name of an id as of the cutoff; an unknown id is shown as it is."""
    names = known.select(*AT, F.col("entity").alias(column), F.col("name").alias(name))
    return rows.join(names, [*AT, column], "left").withColumn(name, F.coalesce(name, F.col(column).cast("string")))


def timeline(events: DataFrame, known: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(novel, cutoff, event, chapter, label, members, places, place_in_order) of events (event, novel, chapter, label, members, places) up to each cutoff.

    Ids are names of the time, in order of the ids. Events are numbered by chapter and event within a novel and cutoff: numbers come
    from counts of the chapters before and a window within each chapter, so that a novel isn't one window.
    """
    shown = events.crossJoin(F.broadcast(cutoffs)).where("chapter <= cutoff")
    lists = []
    for c in ("members", "places"):
        each = named_at(shown.select(*AT, "event", F.explode(F.array_distinct(c)).alias("_id")), known, "_id", "_name")
        lists.append(each.groupBy(*AT, "event").agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_name"))), lambda x: x["_name"]).alias(c)))
    from pyspark.sql import Window as W

    counts = events.groupBy("novel", "chapter").agg(F.count("*").alias("_n"))
    before = counts.select("novel", "chapter", (F.sum("_n").over(W.partitionBy("novel").orderBy("chapter")) - F.col("_n")).alias("_before"))
    placed = shown.select(*AT, "event", "chapter", "label").join(before, ["novel", "chapter"])
    placed = placed.withColumn("position", (F.col("_before") + F.row_number().over(W.partitionBy(*AT, "chapter").orderBy("event"))).cast("long")).drop("_before")
    none = F.array().cast("array<string>")
    out = placed.join(lists[0], [*AT, "event"], "left").join(lists[1], [*AT, "event"], "left")
    return out.select(*AT, "event", "chapter", "position", "label", F.coalesce("members", none).alias("members"), F.coalesce("places", none).alias("places"))


def character_pages(known: DataFrame, cutoffs: DataFrame, relationships: DataFrame, dynamics: DataFrame, events: DataFrame, possessions: DataFrame, locations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row a known character and cutoff: name, relationships, dynamics, events, holds, place and history.

    known: novel, entity, cutoff, name, entity_type. The others as ``graphs.entity_graph`` takes them; snapshots: novel, entity,
    chapter, state.
    """
    people = known.where("entity_type = 'character'").select(*AT, "entity", "name")
    key = [*AT, "entity"]
    active = reads.active_relationships(relationships, cutoffs).select("novel", "cutoff", "id", "a", "b", "rel_type")
    ties = named_at(reads.oriented_edges(active), known, "other", "_other")
    ties = ties.groupBy(*key).agg(_ordered(["id"], F.concat(F.when(F.col("outgoing"), "").otherwise("of "), "rel_type", F.lit(" "), "_other")).alias("relationships"))
    met = dynamics.crossJoin(F.broadcast(cutoffs)).where("chapter <= cutoff").select(*AT, "a", "b", "label", "chapter", "seq")
    felt = named_at(reads.oriented_edges(met), known, "other", "_other").groupBy(*key).agg(_ordered(["seq"], F.concat_ws(" ", "chapter", "label", "_other")).alias("dynamics"))
    part = events.select("novel", "event", "chapter", "label", F.explode(F.array_distinct("members")).alias("entity")).crossJoin(F.broadcast(cutoffs)).where("chapter <= cutoff")
    told = part.groupBy(*key).agg(_ordered(["chapter", "event"], F.concat_ws(" ", "chapter", "event", "label")).alias("events"))
    held = possessions.crossJoin(F.broadcast(cutoffs)).where(asof.within("since", "until", "cutoff", loses_at_end=True))
    held = named_at(held.select(*key, "object", "id"), known, "object", "_thing").groupBy(*key).agg(_ordered(["id"], F.col("_thing")).alias("holds"))
    here = named_at(folds.located(locations, cutoffs).select(*key, "place", "id"), known, "place", "_place").groupBy(*key).agg(F.max_by("_place", "id").alias("place"))
    past = snapshots.crossJoin(F.broadcast(cutoffs)).where("chapter <= cutoff").groupBy(*key).agg(_ordered(["chapter"], F.concat_ws(" ", "chapter", "state")).alias("history"))
    out = people
    for x in (ties, felt, told, held, here, past):
        out = out.join(x, key, "left")
    none = F.array().cast("array<string>")
    return out.select(*key, "name", *[F.coalesce(c, none).alias(c) for c in ("relationships", "dynamics", "events", "holds")], "place", F.coalesce("history", none).alias("history"))


def object_pages(known: DataFrame, cutoffs: DataFrame, possessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row a known object and cutoff: name, its holders in order, who holds it now, and the events of its holders while they held it.

    events: novel, event, chapter, members. An event counts where a member holds the object in its chapter.
    """
    key = [*AT, "entity"]
    things = known.where("entity_type = 'object'").select(*key, "name")
    held = possessions.crossJoin(F.broadcast(cutoffs)).where("since <= cutoff").select(*AT, F.col("object").alias("entity"), F.col("entity").alias("holder"), "id", "since", asof.masked("until", "cutoff").alias("until"))
    named = named_at(held, known, "holder", "_holder")
    spans = named.groupBy(*key).agg(
        _ordered(["since", "id"], F.concat(F.col("_holder"), F.lit(" "), F.col("since").cast("string"), F.lit("-"), F.coalesce(F.col("until").cast("string"), F.lit("")))).alias("holders"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("until").isNull(), F.col("_holder")))), ", ").alias("held_by"),
    )
    acts = events.select("novel", "event", "chapter", F.explode(F.array_distinct("members")).alias("holder"))
    met = held.join(acts, ["novel", "holder"]).where((F.col("since") <= F.col("chapter")) & (F.col("chapter") <= F.col("cutoff")) & (F.col("until").isNull() | (F.col("chapter") < F.col("until"))))
    seen = met.groupBy(*key).agg(F.count_distinct("event").alias("n_events"))
    out = things.join(spans, key, "left").join(seen, key, "left")
    return out.select(*key, "name", F.coalesce("holders", F.array().cast("array<string>")).alias("holders"), F.coalesce("held_by", F.lit("")).alias("held_by"), F.coalesce("n_events", F.lit(0)).alias("n_events"))
