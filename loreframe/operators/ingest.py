"""Ingest: cleaning, contracts, merging of chunk records, references, and rewinding a log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.functions import text as X
from loreframe.operators import textjoin
from loreframe.operators.entity import merge_roots, sequence_ratio
from loreframe.sources.files import stored

ATTRIBUTES = ("goals", "physical_state", "appearance", "emotional_state")


def run_log(log: DataFrame, novel: str = "novel") -> DataFrame:
    """One row a novel: how far its fold has gone."""
    return log.groupBy(novel).agg(F.max("chapter").alias("through_chapter"), F.count("*").alias("n_deltas"), F.count_distinct("entity").alias("n_entities"))


def rewind(log: DataFrame, points: DataFrame, novel: str = "novel", chapter: str = "chapter") -> DataFrame:
    """The log without what the named novels (novel, from_chapter) hold from a chapter on; derived tables are recomputed from it."""
    met = log.join(points, novel, "left")
    return met.where(F.col("from_chapter").isNull() | (F.col(chapter) < F.col("from_chapter"))).drop("from_chapter")


def unpaid(commitments: DataFrame, points: DataFrame, novel: str = "novel") -> DataFrame:
    """Commitments after a rewind: later foreshadows go, later payoffs are open again."""
    met = commitments.join(points, novel, "left")
    late = F.coalesce(F.col("payoff_chapter") >= F.col("from_chapter"), F.lit(False))
    met = met.where(F.col("from_chapter").isNull() | (F.col("foreshadow_chapter") < F.col("from_chapter")))
    return met.withColumns({"status": F.when(late, "pending").otherwise(F.col("status")), "payoff_chapter": F.when(~late, F.col("payoff_chapter"))}).drop("from_chapter")


def check_contiguous(chapters: DataFrame, novel: str = "novel", number: str = "number") -> DataFrame:
    """(novel, number, expected) of chapters that repeat a number or leave a gap."""
    order = F.row_number().over(W.partitionBy(novel).orderBy(number))
    return chapters.withColumn("expected", order).where(F.col(number) != F.col("expected")).select(novel, number, "expected")


def clean_deltas(rows: DataFrame) -> DataFrame:
    """rows with reason: null where a delta is fit to be kept."""
    reason = (
        F.when(~F.col("kind").isin("possession", "location", "status"), "unknown kind")
        .when((F.col("kind") == "possession") & F.col("object").isNull(), "no object")
        .when((F.col("kind") == "possession") & ~F.coalesce(F.col("change").isin("gain", "loss"), F.lit(False)), "bad change")
        .when((F.col("kind") == "location") & F.col("location").isNull(), "no location")
        .when((F.col("kind") == "status") & ~F.coalesce(F.col("attribute").isin(*ATTRIBUTES), F.lit(False)), "bad attribute")
    )
    return rows.withColumn("reason", reason)


def contract_violations(rows: DataFrame, row_id: str, rules: dict[tuple[str, str], Column]) -> DataFrame:
    """(row_id, field, rule) for every rule that a row breaks; null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"))) for (f, r), ok in rules.items()]))
    return rows.select(F.col(row_id).alias("row_id"), F.explode(broken).alias("x")).select("row_id", "x.field", "x.rule")


def sliding_chunks(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """docs with chunk_index, start and chunk: windows of ``size`` words, each beginning size - overlap words after the one before, until one reaches the end.

    A chunk is the text itself from its first word to its last, white space and all: substr(text, start, length(chunk)).
    Places of words are summed a step at a time.
    """
    step = size - overlap
    rows = docs.withColumn("_words", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+\s*"), F.lit(0))).where(F.size("_words") > 0)
    joined = lambda first, n: F.array_join(F.slice("_words", first, n), "")
    last = F.greatest(F.ceil((F.size("_words") - size) / F.lit(step)).cast("int"), F.lit(0))
    lead = F.length(F.regexp_extract(text, r"^\s*", 0)) + 1
    # an empty sequence counts down from 1 to 0
    starts = F.aggregate(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), F.array(lead), lambda s, k: F.array_append(s, F.element_at(s, -1) + F.length(joined((k - 1) * step + 1, F.lit(step)))))
    each = rows.select("*", F.posexplode(starts).alias("chunk_index", "start"))
    return each.withColumn("chunk", F.regexp_replace(joined(F.col("chunk_index") * step + 1, F.lit(size)), r"\s+$", "")).drop("_words")


def merge_entities(rows: DataFrame, keys: list[str], order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Records of one name: of each scalar the first that isn't empty, of each list the distinct union in order."""
    first = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in scalars]
    union = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias(c) for c in lists]
    return rows.groupBy(*keys).agg(*first, *union)


def concat_distinct(rows: DataFrame, keys: list[str], order: list[str], column: str, separator: str) -> DataFrame:
    """Distinct values in order, joined."""
    first = rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(*keys, column).agg(F.min(F.struct(*order)).alias("_at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", column))), lambda x: x[column]), separator)
    return first.groupBy(*keys).agg(joined.alias(column))


def best_confidence(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The record with the highest confidence, the first of equals."""
    best = F.max_by(F.struct(*columns), F.struct(F.coalesce("confidence", F.lit(1.0)), -F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def referenced_names(rows: DataFrame, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """Distinct (keys, entity_type, name) over the named columns; a column may hold a name or an array of names."""
    kinds = dict(rows.dtypes)
    each = [rows.select(*keys, F.lit(t).alias("entity_type"), (F.explode(c) if kinds[c].startswith("array") else F.col(c)).alias("name")) for c, t in columns.items()]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.where("name is not null and trim(name) <> ''").distinct()


def apply_renames(rows: DataFrame, renames: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """rows whose name columns (keys, entity_type-free renames: name, new_name) are replaced where a rename exists; ignores case."""
    for c in columns:
        own = renames.select(*keys, F.lower("name").alias("_from"), F.col("new_name").alias("_to"))
        rows = rows.withColumn("_from", F.lower(c)).join(own, [*keys, "_from"], "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
    return rows


def resolve_references(references: DataFrame, authoritative: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(resolved with id, unresolved): only names of the entity pass have ids; a reference creates nothing."""
    known = authoritative.select(*keys, F.lower("name").alias("_n"), "id").groupBy(*keys, "_n").agg(F.min("id").alias("id"))
    met = references.withColumn("_n", F.lower("name")).join(known, [*keys, "_n"], "left").drop("_n")
    return met.where("id is not null"), met.where("id is null").drop("id")


def fold_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, name, aliases): sub-locations (name, parent_id) become aliases of their parent."""
    added = children.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    return parents.join(added, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def fold_chains(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places that stay, with the names and aliases of all below them; (source, target) of those that were folded).

    places: id, name, aliases, parent_id. Chains of parents are followed to their ends; in a cycle the least id stays.
    Aliases are distinct and sorted, without the place's own name.
    """
    chain = places.where("parent_id is not null and parent_id <> id").select(F.col("id").alias("source"), F.col("parent_id").alias("target"))
    # a parent that isn't a place ends no chain
    roots = stored(merge_roots(chain.join(places.select(F.col("id").alias("target")), "target", "left_semi")), "place-roots")
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    below = places.join(roots, places["id"] == roots["source"]).select(F.col("target").alias("id"), F.explode(F.array_append(own, F.col("name"))).alias("alias"))
    added = below.groupBy("id").agg(F.collect_set("alias").alias("_new"))
    kept = places.join(roots.select(F.col("source").alias("id")), "id", "left_anti").join(added, "id", "left")
    every = F.array_sort(F.array_remove(F.array_distinct(F.concat(own, F.coalesce("_new", F.array().cast("array<string>")))), F.col("name")))
    return kept.select("id", "name", every.alias("aliases")), roots


def merge_aliases(proposed: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, aliases): proposed (id, alias) that no other entity owns as name or alias, added to what each has."""
    owned = entities.select(F.col("id").alias("_owner"), F.explode(F.array_append("aliases", F.col("name"))).alias("_s")).select("_owner", F.lower("_s").alias("_s")).distinct()
    free = proposed.join(owned, (F.lower("alias") == F.col("_s")) & (F.col("id") != F.col("_owner")), "left_anti")
    # two entities that ask for one surface: the first gets it
    free = free.withColumn("_n", F.min("id").over(W.partitionBy(F.lower("alias")))).where("id = _n")
    new = free.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("_new"))
    out = entities.join(new, "id", "left")
    return out.select("id", X.union_aliases(F.col("name"), F.col("aliases"), F.coalesce("_new", F.array().cast("array<string>"))).alias("aliases"))


def dynamics(rows: DataFrame, order: list[str]) -> DataFrame:
    """(novel, a, b, chapter, description): one row an unordered pair and chapter, distinct descriptions joined; self-pairs go."""
    pairs = rows.where("a <> b").withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    out = concat_distinct(pairs, ["novel", "x", "y", "chapter"], order, "description", " ")
    return out.withColumnsRenamed({"x": "a", "y": "b"})


def link_thread_events(updates: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """updates (keys, update_id, event_text) with event_id: an equal description first, else the first that contains or is contained, else null."""
    # equal texts of the keys share their fate, so they meet once; candidates meet by their folded texts, which keep what lies within what
    said = updates.select(*keys, F.lower(F.trim("event_text")).alias("_a")).distinct().where("_a <> ''").withColumn("_s", X.fold_text("_a"))
    at = F.struct("seq", "event_id")
    told = events.select(*keys, F.lower(F.trim("description")).alias("_b"), "event_id", "seq").groupBy(*keys, "_b").agg(F.min(at).alias("_e")).where("_b <> ''").withColumn("_l", X.fold_text("_b"))
    a, b = said.where("_s <> ''").select(*keys, "_s").distinct(), told.where("_l <> ''").select(*keys, "_l").distinct()
    back = textjoin.contained(b.withColumnRenamed("_l", "_s"), a.withColumnRenamed("_s", "_l"), keys)
    pairs = textjoin.contained(a, b, keys).union(back.select(*keys, "_l", "_s")).distinct()
    met = said.join(pairs, [*keys, "_s"]).join(told, [*keys, "_l"]).select(*keys, "_a", "_b", "_e")
    # what is white space alone folds to nothing: it meets all texts of its keys
    met = met.union(said.where("_s = ''").join(told, keys).select(*keys, "_a", "_b", "_e")).union(said.where("_s <> ''").join(told.where("_l = ''"), keys).select(*keys, "_a", "_b", "_e"))
    met = met.where(F.contains("_a", F.col("_b")) | F.contains("_b", F.col("_a")))
    best = met.groupBy(*keys, "_a").agg(F.min(F.struct((F.col("_a") != F.col("_b")).cast("int").alias("x"), "_e"))["_e"]["event_id"].alias("event_id"))
    return updates.withColumn("_a", F.lower(F.trim("event_text"))).join(best, [*keys, "_a"], "left").drop("_a")


def consolidate_log(log: DataFrame, moved: DataFrame, keys: list[str], text: str) -> DataFrame:
    """log and those distinct moved rows that it lacks, compared by folded text."""
    fold = F.lower(F.trim(text))
    new = moved.withColumn("_t", fold).dropDuplicates([*keys, "_t"]).join(log.select(*keys, fold.alias("_t")).distinct(), [*keys, "_t"], "left_anti").drop("_t")
    return log.unionByName(new.select(*log.columns))


def last_wins(rows: DataFrame, keys: list[str], order: list[str], keep_if_empty: list[str]) -> DataFrame:
    """Upsert: the last record of a key; columns named in keep_if_empty keep their last value that isn't empty."""
    at = F.struct(*order)
    others = [c for c in rows.columns if c not in (*keys, *keep_if_empty)]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), at).alias("_o"), *[F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c) for c in keep_if_empty])
    return out.select(*keys, "_o.*", *keep_if_empty)


def registered_types(custom: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities whose type is registered, with its casing, and the rejected ones)."""
    names = registry.select(F.lower(F.trim("type_name")).alias("_t"), F.col("type_name")).groupBy("_t").agg(F.min("type_name").alias("type_name"))
    met = custom.withColumn("_t", F.lower(F.trim("entity_type"))).join(names, "_t", "left").drop("_t")
    return met.where("type_name is not null").withColumn("entity_type", F.col("type_name")).drop("type_name"), met.where("type_name is null").drop("type_name")


def select_context(mentions: DataFrame, roster: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """(keys, id, position): mentioned entities in order of the roster, then the rest by recency, ``cap`` at most.

    mentions: keys, id. roster: keys, id, place, recency.
    """
    met = roster.join(mentions.select(*keys, "id", F.lit(True).alias("_m")).distinct(), [*keys, "id"], "left")
    order = [F.col("_m").isNull(), F.when(F.col("_m"), F.col("place")), F.desc("recency"), F.col("place")]
    return met.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= cap).select(*keys, "id", "position")


def match_payoffs(payoffs: DataFrame, commitments: DataFrame, keys: list[str], least: float = 0.45, second: float = 0.6) -> DataFrame:
    """(keys, payoff_id, commitment_id, score): payoffs in order of payoff_seq take the open commitment they fit best, the first of equals.

    payoffs: keys, payoff_id, payoff_seq, matches (what the payoff says it answers, may be null), payoff (its own
    text). commitments: keys, commitment_id, foreshadow. The score is the sequence ratio of matches and foreshadow, or
    ``second`` times that of payoff and foreshadow, whichever is higher; it must reach ``least``. A ratio bounds the
    quotient of the lengths, so that payoffs meet only commitments of a fitting length (by powers of two). The greedy
    step takes one value of keys at a time, but at most the square of its commitments: a payoff that a commitment fits takes
    that one or another, so of n commitments each is gone with the n-th payoff that it fits.
    """
    reach = int(np.ceil(np.log2(2 / least - 1)))
    level = lambda c: F.floor(F.log2(F.greatest(F.length(c), F.lit(1)))).cast("int")
    c = commitments.select(*keys, "commitment_id", F.lower("foreshadow").alias("_f")).where("_f <> ''")
    at = c.select("*", F.explode(F.sequence(level("_f") - reach, level("_f") + reach)).alias("_at"))
    said = [F.struct(F.lower(x).alias("x"), F.lit(w).alias("w")) for x, w in (("matches", 1.0), ("payoff", second)) if w >= least]
    p = payoffs.where("payoff_seq is not null").select(*keys, "payoff_id", "payoff_seq", F.explode(F.array(*said)).alias("_s")).select(*keys, "payoff_id", "payoff_seq", F.col("_s.x").alias("_x"), F.col("_s.w").alias("_w"))
    met = p.where("_x <> ''").withColumn("_at", level("_x")).join(at, [*keys, "_at"]).where(2 * F.col("_w") * F.least(F.length("_x"), F.length("_f")) >= F.lit(least - 1e-9) * (F.length("_x") + F.length("_f")))
    scored = met.withColumn("score", F.col("_w") * sequence_ratio("_x", "_f", F.lit(least) / F.col("_w"))).where(F.col("score") >= least)
    scored = scored.groupBy(*keys, "payoff_id", "payoff_seq", "commitment_id").agg(F.max("score").alias("score"))
    place = F.dense_rank().over(W.partitionBy(*keys, "commitment_id").orderBy("payoff_seq"))
    scored = scored.withColumn("_place", place).join(c.groupBy(*keys).agg(F.count_distinct("commitment_id").alias("_n")), keys).where("_place <= _n").drop("_place", "_n")
    schema = ", ".join([*(f"{k} {t}" for k, t in payoffs.select(*keys).dtypes), "payoff_id long", "commitment_id long", "score double"])

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, own in group.sort_values(["payoff_seq", "score", "commitment_id"], ascending=[True, False, True]).groupby("payoff_seq", sort=True):
            for row in own.itertuples():
                if row.commitment_id not in used:
                    used.add(row.commitment_id)
                    out.append([getattr(row, k) for k in keys] + [row.payoff_id, row.commitment_id, row.score])
                    break
        return pd.DataFrame(out, columns=[*keys, "payoff_id", "commitment_id", "score"])

    return scored.groupBy(*keys).applyInPandas(greedy, schema)


def parse_extractions(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with record: the JSON of a column, else that of its outermost braces, else an empty record."""
    braces = F.regexp_extract(F.col(column), r"(?s)\{.*\}", 0)
    return rows.withColumn("record", F.coalesce(F.from_json(braces, schema), F.from_json(F.lit("{}"), schema)))
