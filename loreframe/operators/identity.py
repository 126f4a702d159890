"""The merge of entities as one plan over every table that names them, history included.

merges: source, target (one target a source; chains are followed, see ``entity.merge_roots``). Each table is repointed by joins on
the ids that it holds, wherever they stand: in columns, in arrays, or in the structs of version payloads; only rows that hold a
merged id meet the merges twice. Then each table's own rule says which of the rows that have become one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Where ids stand in the payloads of each table's versions: single ids and arrays of ids.
PATHS = {"entities": ((), ()), "locations": (("parent",), ()), "scenes": (("place",), ("members",))}


def repointed(rows: DataFrame, key: list[str], merges: DataFrame, scalars: tuple[str, ...] = (), arrays: tuple[str, ...] = ()) -> DataFrame:
    """rows whose ids at the given paths (columns, or fields of a struct column as ``column.field``) are merged.

    Arrays keep the first place of an id. Rows are known by key.
    """
    none = F.array().cast("array<long>")
    ids = F.array_compact(F.concat(F.array(*[F.col(c).cast("long") for c in scalars]) if scalars else none, *[F.coalesce(F.col(c).cast("array<long>"), none) for c in arrays]))
    each = rows.select(*key, F.explode(F.array_distinct(ids)).alias("source")).join(merges, "source")
    found = each.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("_to"))
    out = rows.join(found, key, "left")
    new = lambda x: F.coalesce(F.try_element_at("_to", x.cast("long")), x)
    for path in (*scalars, *arrays):
        column, _, inner = path.partition(".")
        value = F.col(path)
        fresh = new(value) if path in scalars else F.array_distinct(F.transform(value, new))
        out = out.withColumn(column, F.when(F.col("_to").isNull() | F.col(column).isNull(), F.col(column)).otherwise(F.col(column).withField(inner, fresh) if inner else fresh))
    return out.drop("_to")


def _first(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _alias_union(name: Column, *lists: Column) -> Column:
    """Distinct names in order of the lists, without the empty one and the name itself in any case."""
    every = F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
    return F.filter(every, lambda a: (a != "") & (F.lower(a) != F.lower(name)))


def absorbed(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(target, names, aliases): names of what each target absorbs, in order of id, and their aliases, each with the name after its own."""
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    met = entities.join(merges, entities["id"] == merges["source"]).select("target", "source", "name", F.array_append(own, F.col("name")).alias("all"))
    lists = F.array_sort(F.collect_list(F.struct("source", "name", "all")))
    return met.groupBy("target").agg(F.transform(lists, lambda x: x["name"]).alias("names"), F.flatten(F.transform(lists, lambda x: x["all"])).alias("added"))


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities (id, name, aliases) that stay; a target knows the names and aliases that it absorbs."""
    kept = entities.join(merges.select(F.col("source").alias("id")), "id", "left_anti")
    met = kept.join(absorbed(entities, merges).withColumnRenamed("target", "id"), "id", "left")
    return met.withColumn("aliases", F.when(F.col("added").isNull(), F.col("aliases")).otherwise(_alias_union(F.col("name"), F.col("aliases"), F.col("added")))).drop("names", "added")


def merged_relationships(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Relationships (id, a, b, rel_type, mutual, from_chapter, to_chapter, notes, successor): no self-pairs; of a target's equal ones the oldest stays.

    Equal means in all but the id, and mutual ones in either direction. What supersedes or is superseded is evidence and stays.
    """
    moved = repointed(rows, ["id"], merges, ("a", "b")).where("a <> b")
    follows = rows.where("successor is not null").select(F.col("successor").alias("id")).distinct().withColumn("_follows", F.lit(True))
    targets = merges.select("target").distinct()
    touched = moved.join(targets.select(F.col("target").alias("a"), F.lit(True).alias("_ta")), "a", "left").join(targets.select(F.col("target").alias("b"), F.lit(True).alias("_tb")), "b", "left").join(follows, "id", "left")
    loose = F.col("successor").isNull() & F.col("_follows").isNull() & (F.col("_ta").isNotNull() | F.col("_tb").isNotNull())
    touched = touched.withColumns({"_loose": loose, "_x": F.when(F.col("mutual"), F.least("a", "b")).otherwise(F.col("a")), "_y": F.when(F.col("mutual"), F.greatest("a", "b")).otherwise(F.col("b"))})
    one = _first(touched.where("_loose"), ["_x", "_y", "rel_type", "mutual", "from_chapter", "to_chapter", "notes"], ["id"])
    return touched.where("not _loose").unionByName(one).select(*rows.columns)


def merged_dynamics(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Dynamics (id, a, b, chapter, ...): no self-pairs, one for each pair and chapter: one that was there before, else the oldest."""
    before = rows.select("id", F.col("a").alias("_a"), F.col("b").alias("_b"))
    moved = repointed(rows, ["id"], merges, ("a", "b")).where("a <> b").join(before, "id").withColumn("_moved", (F.col("a") != F.col("_a")) | (F.col("b") != F.col("_b")))
    return _first(moved, ["a", "b", "chapter"], ["_moved", "id"]).select(*rows.columns)


def merged_canon(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Canon facts (id, subject, predicate, value): the target's own value of a predicate wins, else that of the oldest."""
    before = rows.select("id", F.col("subject").alias("_s"))
    moved = repointed(rows, ["id"], merges, ("subject",)).join(before, "id").withColumn("_moved", F.col("subject") != F.col("_s"))
    return _first(moved, ["subject", "predicate"], ["_moved", "id"]).select(*rows.columns)


def merged_history(versions: DataFrame, entities: DataFrame, merges: DataFrame, paths: dict = PATHS) -> DataFrame:
    """Versions (tbl, row, chapter, payload) as if the merges had always been so.

    Ids within payloads are repointed by the table's paths. A version of an absorbed row becomes one of the target; tombstones of
    absorbed rows go. The target's records have its present name, and former names are aliases. Where several fall on one
    chapter the target's own wins (else that of the greatest source), with the aliases of all and the earliest appearance.
    payload: struct with name, aliases and first besides the ids.
    """
    keyed = versions.join(merges.select(F.col("source").alias("row"), F.col("target").alias("_t")), "row", "left").where("_t is null or payload is not null")
    keyed = keyed.select("tbl", F.col("row").alias("_old"), F.coalesce("_t", "row").alias("row"), F.col("_t").isNull().alias("_own"), "chapter", "payload")
    parts = [repointed(keyed.where(F.col("tbl") == t), ["_old", "chapter"], merges, tuple(f"payload.{p}" for p in one), tuple(f"payload.{p}" for p in many)) for t, (one, many) in paths.items()]
    moved = parts[0]
    for p in parts[1:]:
        moved = moved.unionByName(p)
    moved = moved.unionByName(keyed.where(~F.col("tbl").isin(*paths)))
    facts = absorbed(entities, merges).join(entities.select(F.col("id").alias("target"), F.col("name").alias("_name")), "target").select(F.col("target").alias("row"), "names", "_name")
    moved = moved.join(facts, "row", "left")
    named = F.col("payload").withField("aliases", _alias_union_exact(F.col("_name"), F.col("payload.aliases"), F.array(F.col("payload.name")), F.col("names"))).withField("name", F.col("_name"))
    moved = moved.withColumn("payload", F.when(F.col("payload").isNull() | F.col("_name").isNull(), F.col("payload")).otherwise(named))
    lists = moved.groupBy("tbl", "row", "chapter").agg(F.array_sort(F.collect_list(F.struct("_own", "_old", "payload"))).alias("l"))
    last, there = F.element_at("l", -1)["payload"], F.filter("l", lambda x: x["payload"].isNotNull())
    aliases = F.array_distinct(F.flatten(F.transform(there, lambda x: F.coalesce(x["payload"]["aliases"], F.array().cast("array<string>")))))
    whole = last.withField("aliases", aliases).withField("first", F.array_min(F.transform(there, lambda x: x["payload"]["first"])))
    return lists.select("tbl", "row", "chapter", F.when(F.size("l") == 1, last).when(last.isNotNull(), whole).alias("payload"))


def _alias_union_exact(name: Column, *lists: Column) -> Column:
    every = F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
    return F.filter(every, lambda a: a.isNotNull() & (a != "") & (a != name))
