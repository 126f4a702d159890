"""The driver's tables as model tables, in Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where a table is dealt by key before it is grouped.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by key, in as many tasks as their number asks for, so that what a task groups or sorts doesn't grow with the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // TASK_ROWS)), *keys)


#: Characters of the texts of a task that turns them into index rows, which are several times as many bytes.
TASK_CHARS = 32_000_000


def text_tasks(texts: DataFrame, column: str) -> int | None:
    """In how many tasks texts are dealt before they are indexed; None where the session's own are enough."""
    tasks = -(-(texts.agg(F.sum(F.length(column)).alias("n")).first().n or 0) // TASK_CHARS)
    return tasks if tasks > int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: novel, entity, chapter, ordinal, location, object, change, attribute, value."""
    return as_deltas(table(spark, sf_dir, "events"))


def as_deltas(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    attribute = F.element_at(F.array(*[F.lit(a) for a in ("goals", "physical_state", "appearance", "emotional_state", "notes")]), (k % 5 + 1).cast("int"))
    change = F.when(F.col("event_type") == "purchase", "gain").when(F.col("event_type") == "error", "loss")
    return events.select(
        (F.col("user_id") % 10).alias("novel"), F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("chapter"), F.col("event_id").alias("ordinal"),
        F.col("event_type").alias("location"), (k % 5).alias("object"), change.alias("change"), attribute.alias("attribute"), k.cast("string").alias("value"), F.col("value").alias("amount"),
    )


DELTAS = """d as (select user_id % 10 as novel, user_id as entity, day(ts)::int as chapter, event_id as ordinal, event_type as location,
    (props->>'$.k')::bigint % 5 as object, case event_type when 'purchase' then 'gain' when 'error' then 'loss' end as change,
    ['goals','physical_state','appearance','emotional_state','notes'][(props->>'$.k')::bigint % 5 + 1] as attribute, (props->>'$.k') as value, value as amount from events)"""
#: Location and possession intervals over d, in SQL.
LOCATED = """m as (select *, lag(location) over (partition by novel, entity order by chapter, ordinal) as b from d),
n as (select * from m where b is null or b <> location),
loc as (select novel, entity, ordinal as id, location, chapter as since,
    case when lead(chapter) over w is not null then greatest(lead(chapter) over w - 1, chapter) end as until, lead(ordinal) over w as superseded_by
    from n window w as (partition by novel, entity order by chapter, ordinal))"""
HELD = """pm as (select *, coalesce(lag(change) over (partition by novel, entity, object order by chapter, ordinal), 'loss') as b from d where change is not null),
pn as (select *, lead(chapter) over (partition by novel, entity, object order by chapter, ordinal) as until from pm where change <> b),
pos as (select novel, entity, object, ordinal as id, chapter as since, until from pn where change = 'gain')"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """views and clicks as learnt facts; a view replaces the entity's view before it."""
    rows = deltas(spark, sf_dir).where("location in ('view', 'click')")
    from pyspark.sql import Window as W

    nxt = F.lead("ordinal").over(W.partitionBy("novel", "entity", "location").orderBy("chapter", "ordinal"))
    return rows.select("novel", "entity", F.col("ordinal").alias("id"), F.col("value").alias("text"), F.col("chapter").alias("learned"), F.when(F.col("location") == "view", nxt).alias("successor"))


ASSERTED = """a as (select novel, entity, ordinal as id, value as text, chapter as learned,
    case when location = 'view' then lead(ordinal) over (partition by novel, entity, location order by chapter, ordinal) end as successor from d where location in ('view', 'click')),
ae as (select a.*, x.learned as expires from a left join a x on a.successor = x.id)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as states: novel, row, chapter (year), payload (status and price of the year's last order), F is a tombstone."""
    order = F.struct("o_orderdate", "o_orderkey")
    last = F.max_by(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")), order)
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("row"), F.year("o_orderdate").alias("chapter")).agg(last.alias("p"))
    return rows.select((F.col("row") % 10).alias("novel"), "row", "chapter", F.when(F.col("p.status") != "F", F.col("p")).alias("payload"))


VERSIONS = """vs as (select o_custkey % 10 as novel, o_custkey as row, year(o_orderdate)::int as chapter, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status,
    arg_max(o_totalprice, (o_orderdate, o_orderkey)) as price from orders group by all),
v as (select novel, row, chapter, case when status <> 'F' then status end as status, case when status <> 'F' then price end as price from vs)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as relationships: id, a (supplier), b (part), rel_type, from_chapter, to_chapter, asserted, successor."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    pair = ["l_suppkey", "l_partkey", "l_returnflag"]
    from pyspark.sql import Window as W

    # both groupings and the id are of one dealing
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *pair, month.alias("m"), F.col("l_quantity").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    rows = dealt(lines, "id").groupBy("id", "l_orderkey", "l_linenumber", *pair).agg(F.min("m").alias("m"), F.min("q").alias("q"))
    rows = rows.groupBy("id").agg(F.min(F.struct(*pair, "m", "q")).alias("x")).select("id", "x.*")
    nxt = F.lead("id").over(W.partitionBy(*pair).orderBy("id"))
    return rows.select("id", F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b"), F.col("l_returnflag").alias("rel_type"), F.col("m").cast("int").alias("from_chapter"), F.when(F.col("q") > 40, F.col("m") + F.col("q").cast("int") % 7).cast("int").alias("to_chapter"), (F.col("m") + 1).cast("int").alias("asserted"), nxt.alias("successor"))


RELATIONS = """r0 as (select l_orderkey * 10 + l_linenumber as id, min((l_suppkey, l_partkey, l_returnflag, m, q)) as x from
    (select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, min((year(l_shipdate) - 1995) * 12 + month(l_shipdate)) as m, min(l_quantity) as q from lineitem group by all) group by 1),
r as (select id, x[1] as a, x[2] + 1000000000 as b, x[3] as rel_type, x[4]::int as from_chapter, case when x[5] > 40 then (x[4] + trunc(x[5])::int % 7)::int end as to_chapter,
    (x[4] + 1)::int as asserted, lead(id) over (partition by x[1], x[2], x[3] order by id) as successor from r0)"""


def chapters(spark: SparkSession, sf_dir: str, tasks: int | None = None, upto: DataFrame | None = None) -> DataFrame:
    """documents as chapters: novel (source), number by doc_id, doc_id, text, lang. Texts stay out of the window; with ``tasks`` they are dealt to as many.

    upto (novel, last), one row a novel: only chapters up to the last. That many ids at most are left, which are sent to the texts, so that these aren't dealt.
    """
    from pyspark.sql import Window as W

    docs = table(spark, sf_dir, "documents")
    number = F.row_number().over(W.partitionBy("novel").orderBy("doc_id"))
    numbers = docs.select(F.col("source").alias("novel"), "doc_id").withColumn("number", number)
    texts = docs.select(F.col("source").alias("novel"), "doc_id", "text", "lang")
    if upto is not None:
        near = numbers.join(F.broadcast(upto), "novel").where("number <= last")
        return texts.join(F.broadcast(near.select("doc_id", "number")), "doc_id")
    numbers = numbers.select("doc_id", "number")
    return (texts if tasks is None else texts.repartition(tasks, "doc_id")).join(numbers, "doc_id")


CHAPTERS = "c as (select source as novel, doc_id, text, lang, row_number() over (partition by source order by doc_id)::int as number from documents)"
