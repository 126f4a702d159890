"""As-of views: listings, statuses, graphs and id-to-name lookups for many cutoffs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreframe.operators.asof import seen_by, unsuperseded


def list_entities(entities: DataFrame, cutoffs: DataFrame, first: str = "first_appearance") -> DataFrame:
    """Entities seen by each cutoff, in order of name."""
    return entities.crossJoin(F.broadcast(cutoffs)).where(seen_by(first, "cutoff")).orderBy("cutoff", "name")


def thread_status_at(status: Column, closed: Column, cutoff: Column, uncapped: Column) -> Column:
    """closed where it closed by the cutoff, or at no known chapter and nothing is hidden; else a closed thread is progressing."""
    is_closed = status == "closed"
    return F.when(is_closed & closed.isNotNull() & (closed <= cutoff), "closed").when(is_closed & closed.isNull() & uncapped, "closed").when(is_closed, "progressing").otherwise(status)


def commitment_status_at(status: Column, payoff: Column, cutoff: Column, uncapped: Column) -> Column:
    """broken and abandoned only where nothing is hidden; satisfied where the payoff isn't later; else pending."""
    return F.when(status.isin("broken", "abandoned") & uncapped, status).when(payoff <= cutoff, "satisfied").otherwise("pending")


def flag_resolved_at(resolved: Column, chapter: Column, cutoff: Column, uncapped: Column) -> Column:
    return resolved & F.when(chapter.isNotNull(), chapter <= cutoff).otherwise(uncapped)


def active_relationships(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Relationships (id, from_chapter, to_chapter, asserted, successor) that hold at each cutoff.

    One holds from the later of its start and its assertion to its end, unless its successor has started.
    """
    begun = F.greatest(F.coalesce("from_chapter", F.lit(0)), F.coalesce("asserted", F.lit(0)))
    start = F.coalesce("asserted", "from_chapter", F.lit(0))
    live = unsuperseded(rows, cutoffs, "id", "successor", start)
    return live.where((begun <= F.col("cutoff")) & (F.col("to_chapter").isNull() | (F.col("to_chapter") >= F.col("cutoff"))))


def oriented_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each edge from both of its ends: (entity, other, outgoing, the edge's columns); a union, so that joins stay equi-joins."""
    rest = [c for c in edges.columns if c not in (a, b)]
    there = edges.select(F.col(a).alias("entity"), F.col(b).alias("other"), F.lit(True).alias("outgoing"), *rest)
    back = edges.where(F.col(a) != F.col(b)).select(F.col(b).alias("entity"), F.col(a).alias("other"), F.lit(False).alias("outgoing"), *rest)
    return there.unionByName(back)


def cooccurrence_edges(events: DataFrame, members: str = "members") -> DataFrame:
    """(event, a, b) for unordered pairs of an event's members; an event's list bounds its pairs."""
    own = F.array_sort(F.array_distinct(members))
    each = events.withColumn("_m", own).select("event", "_m", F.posexplode("_m").alias("_i", "a"))
    return each.select("event", "a", F.explode(F.slice("_m", F.col("_i") + 2, F.size("_m"))).alias("b"))


def cross_edges(events: DataFrame, left: str, right: str) -> DataFrame:
    """(event, a, b) for pairs across two lists of an event."""
    return events.select("event", F.explode(F.array_distinct(left)).alias("a"), right).select("event", "a", F.explode(F.array_distinct(right)).alias("b"))


def merge_story_edges(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One edge for each unordered pair from (a, b, source, label): the strongest source and its labels.

    Sources rank dynamic, event, possession, location. The label is the single description, or how many there
    are. Edges are counted by label and source, with numbers alone as what is kept of them (so by hash, not by sort),
    before the labels of a pair meet.
    """
    rank = lambda source: F.when(source == "dynamic", 0).when(source == "event", 1).when(source == "possession", 2).otherwise(3)
    pairs = edges.select(*keys, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "source", "label", *order)
    # a missing place comes first
    first = F.when(F.count("*") == F.count(order[0]), F.min(order[0])) if len(order) == 1 else F.min(F.struct(*order))
    labels = pairs.groupBy(*keys, "x", "y", "label", "source").agg(first.alias("_at"))
    out = labels.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list(F.struct(rank(F.col("source")).alias("rank"), "_at", "label", "source"))).alias("_l"))
    # a label stands where it comes first
    out = out.select(*keys, F.col("x").alias("a"), F.col("y").alias("b"), F.array_min(F.transform("_l", lambda x: F.struct(x["rank"], x["source"].alias("source"))))["source"].alias("source"), F.array_distinct(F.transform("_l", lambda x: x["label"])).alias("_n"))
    return out.select(*keys, "a", "b", "source", F.when(F.size("_n") == 1, F.col("_n")[0]).otherwise(F.concat(F.size("_n").cast("string"), F.lit(" kinds"))).alias("label"), F.array_join("_n", "\n").alias("tooltip"))


def resolve_array_names(rows: DataFrame, row_id: str, ids: str, names: DataFrame) -> DataFrame:
    """(row_id, names): an id array as names in order, unknown ids as text."""
    each = rows.select(row_id, F.posexplode_outer(ids).alias("_i", "id"))
    met = each.join(names, "id", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", F.coalesce("name", F.col("id").cast("string")).alias("name")))))
    return met.groupBy(row_id).agg(F.transform(found, lambda x: x["name"]).alias("names"))


def typed_entities(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, entity_type, name) of all typed tables in one, so that a lookup is one join."""
    parts = [df.select("entity", F.lit(kind).alias("entity_type"), "name") for kind, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def threads_with_events(threads: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """threads with their events in order: events has key, chapter, seq, label."""
    lists = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "seq", "label"))), lambda x: x["label"]).alias("events"))
    return threads.join(lists, key, "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))
