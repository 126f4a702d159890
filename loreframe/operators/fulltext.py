"""Full text with positions: phrases, OR, negation, and cover-density rank, for items of several kinds at once.

An index has one row for each item, term and field weight, with the places of the term; stop words take a place but have
no row, and the places of a later field follow those of the field before. It is written once, by buckets of the
term, and a search reads the buckets of its terms only. An item's words are grouped in its row and never dealt.

Queries are in web-search form: words, ``"a phrase"``, ``or``, and ``-`` before what must not occur. ``or`` binds less than
what stands next to each other. A query without a negation is relaxed: each of its words and phrases may match alone.

Rank: a cover is a run of places in which the query holds and no shorter run within it does. It counts the harmonic
mean of the weights of the query's places in it, over one more than the places in it that the query doesn't name. For
relaxed words every place is a cover, so their rank is a sum of weights that needs no places.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.functions import text as X
from loreframe.operators.asof import topk
from loreframe.operators.retrieval import WEIGHTS, placed, rrf, words

BUCKETS = 32


def _placed(found: Column, weight: float, before: Column) -> Column:
    return F.transform(found, lambda t, i: F.struct(t.alias("term"), F.lit(weight).alias("weight"), (i + before + 1).cast("int").alias("place")))


def positions(items: DataFrame, fields: dict[str, str], keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(keys, term, weight, places): the places of each term, rising; an item is one row. fields: column -> weight class, in order.

    wanted (novel, term, last): only these terms in items of the novel up to the chapter ``last``, for a search that comes once.
    It is a stated set of queries' terms, and is sent to the tasks, so that other places are never dealt.
    """
    if wanted is None:
        return placed(items, fields, keys)
    own = [f"_w{k}" for k in range(len(fields))]
    rows = items.select(*keys, *[words(c).alias(w) for c, w in zip(fields, own, strict=True)])
    parts, before = [], F.lit(0)
    for w, kind in zip(own, fields.values(), strict=True):
        parts.append(_placed(F.col(w), WEIGHTS[kind], before))
        before = before + F.size(w)
    each = rows.select(*keys, F.explode(F.concat(*parts)).alias("p")).select(*keys, "p.*").where(~F.col("term").isin(*X.STOPWORDS))
    each = each.join(F.broadcast(wanted), ["novel", "term"]).where("chapter <= last").select(*keys, "term", "weight", "place")
    return each.groupBy(*keys, "term", "weight").agg(F.array_sort(F.collect_list("place")).alias("places"))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """One folder by bucket of the term. Each task sorts the terms of its items and adds a file to each bucket: the index isn't dealt,
    so that a common term is in as many files as there are tasks."""
    rows = index.withColumn("term_bucket", _bucket("term", buckets))
    rows.sortWithinPartitions("term_bucket", "term").write.partitionBy("term_bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The index's rows of the buckets that hold the terms: at most ``buckets`` numbers are collected to prune the scan."""
    wanted = [r.b for r in terms.select(_bucket("term", buckets).alias("b")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("term_bucket").isin(wanted)).drop("term_bucket")


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, relaxed, clause, operand, negated, offset, term, width) of the terms of each query.

    An operand is a word, or a phrase of ``width`` terms at their offsets. Clauses are what ``or`` parts; in a relaxed query
    each operand is a clause of its own. Stop words are left out, with their negation.
    """
    tokens = queries.select("query_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r'-?"[^"]*"?|[^\s"]+'), F.lit(0))).alias("place", "token"))
    so_far = W.partitionBy("query_id").orderBy("place")
    tokens = tokens.withColumns({"_or": F.lower("token") == "or", "clause": F.sum((F.lower("token") == "or").cast("int")).over(so_far)}).where("not _or")
    each = tokens.select("query_id", "place", "clause", F.startswith("token", F.lit("-")).alias("negated"), F.contains("token", F.lit('"')).alias("_phrase"), F.posexplode(words("token")).alias("offset", "term"))
    each = each.where(~F.col("term").isin(*X.STOPWORDS)).withColumn("operand", F.col("place") * 4096 + F.when(F.col("_phrase"), 0).otherwise(F.col("offset")))
    operand = W.partitionBy("query_id", "operand")
    each = each.withColumns({"offset": F.col("offset") - F.min("offset").over(operand), "width": F.count("*").over(operand).cast("int"), "relaxed": ~F.max("negated").over(W.partitionBy("query_id"))})
    return each.select("query_id", "relaxed", F.when(F.col("relaxed"), F.col("operand")).otherwise(F.col("clause")).cast("int").alias("clause"), F.col("operand").cast("int").alias("operand"), "negated", F.col("offset").cast("int").alias("offset"), "term", "width")


def cover_density(occurrences: list, needs: dict[int, int], places: list[tuple[int, float]]) -> float:
    """The rank of one item: occurrences (end, begin, clause, operand) of operands, needs: operands of each clause, places: (place, weight)."""
    places = sorted(places)
    at, sums = [p for p, _ in places], [0.0]
    for _, weight in places:
        sums.append(sums[-1] + 1 / weight)
    latest: dict[int, dict[int, int]] = {}
    total, last, occurrences = 0.0, 0, sorted(occurrences)
    for i, (end, begin, clause, operand) in enumerate(occurrences):
        held = latest.setdefault(clause, {})
        held[operand] = max(begin, held.get(operand, 0))
        if i + 1 < len(occurrences) and occurrences[i + 1][0] == end:
            continue
        begin = max((min(x.values()) for c, x in latest.items() if len(x) == needs[c]), default=0)
        if begin > last:  # no cover before lies within this one, and none after it can
            a, b = bisect_left(at, begin), bisect_right(at, end)
            total += (b - a) / (sums[b] - sums[a]) / (1 + (end - begin) - (b - a - 1))
            last = begin
    return total


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        scores = [cover_density([(o["end"], o["begin"], o["clause"], o["operand"]) for o in occ], {o["clause"]: o["needs"] for o in occ}, [(p["place"], p["weight"]) for p in places]) for occ, places in zip(batch["_occ"], batch["_places"], strict=True)]
        yield batch.drop(columns=["_occ", "_places"]).assign(raw=scores)


def matched(queries: DataFrame, parsed: DataFrame, index: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """(query_id, keys, raw) of the items that satisfy a query within its scope and up to its max_chapter, with a rank above 0.

    index: scope, keys, chapter, term, weight, places.
    """
    asked = queries.select("query_id", *scope, "max_chapter").join(parsed, "query_id")
    plain = parsed.groupBy("query_id").agg((F.min("relaxed") & (F.max("width") == 1)).alias("_plain"))
    group = ["query_id", *keys]
    # dealt once, by query and item with places in lists: all that follows is grouped and joined by at least these
    hits = index.join(asked, [*scope, "term"]).where("chapter <= max_chapter").select(*group, "term", "weight", "clause", "operand", "negated", "offset", "width", "places").repartition(*group)
    # relaxed words: every place is a cover
    words_ = hits.join(F.broadcast(plain.where("_plain")), "query_id").select(*group, "term", "weight", F.size("places").alias("tf")).distinct()
    words_ = words_.groupBy(*group).agg(F.sum(F.col("weight") * F.col("tf")).alias("raw"))
    rest = hits.join(F.broadcast(plain.where("not _plain")), "query_id")
    each = rest.select(*group, "clause", "operand", "negated", "offset", "width", "weight", F.explode("places").alias("place"))
    found = each.groupBy(*group, "clause", "operand", "negated", "width", (F.col("place") - F.col("offset")).alias("begin")).agg(F.count_distinct("offset").alias("_hit"), F.max("place").alias("end")).where("_hit = width")
    needs = parsed.where("not negated").groupBy("query_id", "clause").agg(F.count_distinct("operand").cast("int").alias("needs"))
    own = F.collect_list(F.when(~F.col("negated"), F.struct("end", "begin", "clause", "operand")))
    clauses = found.groupBy(*group, "clause").agg(F.size(F.collect_set(F.when(~F.col("negated"), F.col("operand")))).alias("_have"), F.max("negated").alias("_bad"), own.alias("_own"))
    alive = clauses.join(F.broadcast(needs), ["query_id", "clause"]).where("_have = needs and not _bad")
    told = F.transform("_own", lambda o: F.struct(o["end"].alias("end"), o["begin"].alias("begin"), o["clause"].alias("clause"), o["operand"].alias("operand"), F.col("needs")))
    occurrences = alive.select(*group, told.alias("_o")).groupBy(*group).agg(F.flatten(F.collect_list("_o")).alias("_occ"))
    # the places of one query's terms in one item
    places = each.groupBy(*group).agg(F.collect_set(F.struct("place", "weight")).alias("_places"))
    rows = occurrences.join(places, group)
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.select(*group).dtypes), "raw double"])
    return words_.unionByName(rows.mapInPandas(_ranked, schema)).withColumn("raw", F.round("raw", 9)).where("raw > 0")


def text_search(queries: DataFrame, index: DataFrame, scope: list[str], keys: list[str], limit: int = 50, parsed: DataFrame | None = None) -> DataFrame:
    """(query_id, keys, score, rank): the first ``limit`` of each query and, where keys has one, kind; score is over the list's best, ties by the last key."""
    parsed = parse_queries(queries) if parsed is None else parsed
    lists = ["query_id", *(["kind"] if "kind" in keys else [])]
    best = topk(matched(queries, parsed, index, scope, keys), lists, [F.desc("raw"), F.col(keys[-1])], limit)
    return best.select("query_id", *keys, F.round(F.col("raw") / F.max("raw").over(W.partitionBy(*lists)), 9).alias("score"), "rank")


def fused(keyword: DataFrame, dense: DataFrame, kinds: list[str], limit: int = 50) -> DataFrame:
    """(query_id, kind, item, score, rank, first_list) of the keyword and vector lists of all kinds, fused by rank.

    Lists come in order of the kinds, words before vectors; an item of several lists is represented by its place in the
    first of them. A query without vectors has its keyword lists alone.
    """
    number = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) * 2 - 2
    item = F.concat_ws(":", "kind", F.lpad(F.col("item").cast("string"), 20, "0"))
    lists = keyword.select("query_id", number.cast("int").alias("list_no"), "rank", item.alias("item")).unionByName(dense.select("query_id", (number + 1).cast("int").alias("list_no"), "rank", item.alias("item")))
    first = lists.groupBy("query_id", "item").agg(F.min("list_no").alias("first_list"))
    out = rrf(lists, ["query_id"], limit=limit).join(first, ["query_id", "item"])
    return out.select("query_id", F.substring_index("item", ":", 1).alias("kind"), F.substring_index("item", ":", -1).cast("long").alias("item"), "score", "rank", "first_list")
