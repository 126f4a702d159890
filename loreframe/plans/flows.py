"""Queries that write and read back, and the streaming fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreframe.operators import asof, checks, entity, folds, ingest, refold
from loreframe.plans import bind, names, records
from loreframe.plans.bind import ASSERTED, DELTAS, HELD, LOCATED, VERSIONS
from loreframe.sources import files
from loreframe.streaming import edges

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def shared(spark, name: str) -> str:
    return files.scratch(spark, name)


@query(f"with {DELTAS}, {LOCATED} select novel, entity, id, location, since, until from loc where until is not null")
def stream_location_edges(spark, sf):
    """The closed intervals, by a stream over the event files that ends when it has read them."""
    path, provider = shared(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, edges.ROCKS)
    try:
        schema = bind.table(spark, sf, "events").schema
        events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
        deltas = events.select((F.col("user_id") % 10).alias("novel"), F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("chapter"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("location"))
        run = edges.stream_location_edges(deltas).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{path}/out").where("kind = 'closed'").drop("kind")


def _streamed(spark, sf, make):
    """What a stream over the event files puts out until it has read them."""
    path, provider = shared(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, edges.ROCKS)
    try:
        log = bind.deltas(spark, sf)  # the same columns, from a stream
        events = spark.readStream.schema(bind.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
        run = make(bind.as_deltas(events).select(*log.columns)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{path}/out")


@query(f"with {DELTAS}, {LOCATED}, {HELD} select 'location' as kind, novel, entity, null::bigint as object, id, location, since, until from loc where until is not null union all select 'possession', novel, entity, object, id, null, since, until from pos where until is not null")
def stream_edges(spark, sf):
    """Closed intervals of both kinds from one pass of a stream."""
    return _streamed(spark, sf, edges.stream_edges).where("kind <> 'late'")


#: The rewind of novels divisible by 3: from chapter 10 + novel on, every other change is gone and every fifth is elsewhere.
_RETCON = "rc as (select novel, entity, chapter, ordinal, case when novel % 3 = 0 and chapter >= 10 + novel and ordinal % 5 = 0 then 'elsewhere' else location end as location, object, change, attribute, value from d where not (novel % 3 = 0 and chapter >= 10 + novel and ordinal % 2 = 1))"


def retold(spark, sf):
    """(old log, new log, points) of the rewind."""
    old = bind.deltas(spark, sf)
    points = old.select("novel").distinct().where("novel % 3 = 0").select("novel", (F.col("novel") + 10).cast("int").alias("from_chapter"))
    late = (F.col("novel") % 3 == 0) & (F.col("chapter") >= 10 + F.col("novel"))
    new = old.where(~(late & (F.col("ordinal") % 2 == 1))).withColumn("location", F.when(late & (F.col("ordinal") % 5 == 0), "elsewhere").otherwise(F.col("location")))
    return old, new, points


def _refolded(spark, sf, make, fold, columns=("*",)):
    """A table stored from the old log, refolded in place for the new one."""
    old, new, points = retold(spark, sf)
    path = shared(spark, "derived")
    refold.write_table(make(old), path)
    entities = files.stored(refold.touched(old, new, points), "touched")
    refold.refold_table(path, fold, refold.suffix(new, entities), entities)
    return spark.read.parquet(path).drop("bucket").select(*columns)


@query(f"with {DELTAS}, {_RETCON}, {LOCATED.replace('from d)', 'from rc)')} select * from loc")
def refolded_locations(spark, sf):
    return _refolded(spark, sf, folds.location_edges, refold.refold_locations)


@query(f"with {DELTAS}, {_RETCON}, {HELD.replace('from d where', 'from rc where')} select * from pos")
def refolded_possessions(spark, sf):
    return _refolded(spark, sf, lambda log: folds.possession_edges(log.where("change is not null")), refold.refold_possessions)


@query(f"""with {DELTAS}, {_RETCON}, s0 as (select novel, entity, chapter, {', '.join(f"arg_max(value, ordinal) filter (attribute = '{a}') as {a}" for a in (*folds.CARRIED, *folds.NOT_CARRIED))} from rc group by all)
select novel, entity, chapter, {', '.join(f"last_value({a} ignore nulls) over w as {a}" for a in folds.CARRIED)}, {', '.join(folds.NOT_CARRIED)} from s0 window w as (partition by novel, entity order by chapter rows between unbounded preceding and current row)""")
def refolded_snapshots(spark, sf):
    return _refolded(spark, sf, folds.state_snapshots, refold.refold_snapshots)


@query(f"with {DELTAS}, {_RETCON}, x as (select * from rc where entity % 11 <> 5), {LOCATED.replace('from d)', 'from x)')}, k as (select novel, count(*) as n from rc where entity % 11 = 5 group by all), e as (select novel, count(*) as n_edges from loc where since <= 20 group by all), p as (select distinct novel from rc) select p.novel, coalesce(n_edges, 0) as n_edges, coalesce(n, 0) as n_skipped from p left join e using (novel) left join k using (novel)")
def replayed_prefix(spark, sf):
    """Intervals begun up to chapter 20, of changes whose entity is known; the others are counted."""
    _, log, _ = retold(spark, sf)
    known = log.select("novel", "entity").distinct().where("entity % 11 <> 5")
    kept, skipped = refold.resolved(log, {"entity": known})
    begun = folds.location_edges(kept).where("since <= 20").groupBy("novel").agg(F.count("*").alias("n_edges"))
    every = log.select("novel").distinct()
    return every.join(begun, "novel", "left").join(skipped, "novel", "left").select("novel", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_skipped", F.lit(0)).alias("n_skipped"))


@query(f"with {DELTAS}, {ASSERTED}, g as (select id from a where novel % 3 = 0 and learned >= 10 + novel) select novel, entity, id, text, learned, case when successor not in (select id from g) then successor end as successor from a where not (novel % 3 = 0 and learned >= 10 + novel)")
def rewound_knowledge(spark, sf):
    """What was learnt from the points on is gone, and what it superseded is current again."""
    _, _, points = retold(spark, sf)
    return refold.rewound_records(bind.assertions(spark, sf), points, "learned")


@query(f"with {DELTAS.replace('from events)', 'from events where not (user_id % 10 = 3 and day(ts) >= 20))')}, {LOCATED} select * from loc")
def written_projection(spark, sf):
    """The location projection, of which novel 3 is first written whole and then replaced by its rewound form."""
    path = shared(spark, "projection")
    whole = folds.location_edges(bind.deltas(spark, sf))
    files.write_projection(whole, path, buckets=64)
    log = ingest.rewind(bind.deltas(spark, sf), spark.createDataFrame([(3, 20)], "novel long, from_chapter int"))
    bucket = F.pmod(F.xxhash64("novel"), F.lit(64))
    touched = spark.createDataFrame([(3,)], "novel long").select(bucket.alias("_b"))
    files.write_projection(folds.location_edges(log).withColumn("_b", bucket).join(F.broadcast(touched), "_b", "left_semi").drop("_b"), path, buckets=64)
    return spark.read.parquet(path).drop("novel_bucket")


@query("select source as novel, row_number() over (partition by source order by doc_id)::int as number, doc_id from documents")
def stored_chapters(spark, sf):
    path = shared(spark, "chapters")
    files.write_chapters(bind.chapters(spark, sf).select("novel", "number", "doc_id"), path)
    return spark.read.parquet(path).select("novel", "number", "doc_id")


@query("with c as (select source as novel, row_number() over (partition by source order by doc_id)::int as number, doc_id from documents) select novel, number, doc_id, false as rejected from c union all select novel, number, doc_id, true from c where number <= 6 and number % 2 = 0 union all select novel, number, doc_id, true from c where number > 6 and number % 5 = 0")
def appended_chapters(spark, sf):
    """Six chapters of each novel are stored, then all but the odd ones of these are added, some of them twice; with what was rejected."""
    path = shared(spark, "appended")
    rows = bind.chapters(spark, sf).select("novel", "number", "doc_id")
    files.write_chapters(rows.where("number <= 6"), path)
    more = rows.where("number > 6 or number % 2 = 0").unionByName(rows.where("number > 6 and number % 5 = 0"))
    rejected = files.append_chapters(more, path)
    kept = spark.read.parquet(path).select("novel", "number", "doc_id")
    return kept.withColumn("rejected", F.lit(False)).unionByName(rejected.select("novel", "number", "doc_id").withColumn("rejected", F.lit(True)))


@query(f"with {DELTAS}, {LOCATED} select novel, entity, id, location, since from loc where novel in (2, 5, 7) and since <= 12")
def scanned_projection(spark, sf):
    """A derived table read with the predicates of novels and cutoff, which reach the scan."""
    path = shared(spark, "scanned")
    folds.location_edges(bind.deltas(spark, sf)).withColumnRenamed("since", "chapter").repartitionByRange("novel", "chapter").write.partitionBy("novel").parquet(path)
    rows = files.read_table(spark, path, [2, 5, 7], 12)
    return rows.select(F.col("novel").cast("long").alias("novel"), "entity", "id", "location", F.col("chapter").alias("since"))


@query(f"with {names._PARTS}, b as (select novel, surface, arg_max(id, (is_name, -id)) as id from su group by all), c as (select l_orderkey as claim, l_linenumber as line, l_partkey % 8 as novel, p_name || ' ' || l_partkey % 230 as s from lineitem join part on l_partkey = p_partkey) select claim, line, c.novel, id from c left join b on c.novel = b.novel and s = surface")
def resolved_claims(spark, sf):
    p = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    claims = bind.table(spark, sf, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 8).alias("novel"), F.concat(F.lit("The "), "p_name", F.lit(" "), (F.col("l_partkey") % 230).cast("string")).alias("name"))
    known, unknown = checks.resolve_claims(claims, names.names(spark, sf), ["novel"])
    return known.select("claim", "line", "novel", "id").unionByName(unknown.select("claim", "line", "novel", F.lit(None).cast("long").alias("id")))


@query(f"with {names._PARTS}, b as (select novel, surface, min(id % 30 - 3) as first from su group by all), c as (select l_partkey % 8 as novel, l_orderkey % 100 as draft, l_orderkey % 28 as chapter, l_returnflag as kind, p_name || ' ' || l_partkey % 230 as s from lineitem join part on l_partkey = p_partkey) select c.novel, draft, kind, count_if(coalesce(first < chapter, false)) as resolved, count_if(not coalesce(first < chapter, false)) as unresolved, count_if(coalesce(first >= chapter, false)) as later from c left join b on c.novel = b.novel and s = surface group by all")
def claim_coverage(spark, sf):
    """How many names of each draft's claims were known when its chapter began."""
    p = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = bind.table(spark, sf, "lineitem").join(p, "l_partkey")
    claims = rows.select((F.col("l_partkey") % 8).alias("novel"), (F.col("l_orderkey") % 100).alias("draft"), (F.col("l_orderkey") % 28).alias("chapter"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("The "), "p_name", F.lit(" "), (F.col("l_partkey") % 230).cast("string")).alias("name"))
    return checks.claim_coverage(claims, names.names(spark, sf).withColumn("first", F.col("id") % 30 - 3), ["novel"])


@query("""with u as (select p_partkey % 40 as chapter, p_partkey as update_id, lower(trim(p_name)) as a from part where p_partkey % 3 = 0), e as (select p_partkey % 40 as chapter, p_partkey as event_id, lower(trim(case when p_partkey % 2 = 0 then p_name else string_split(p_name, ' ')[1] end)) as b from part where p_partkey % 3 <> 0),
m as (select u.chapter, update_id, arg_min(event_id, ((a <> b)::int, event_id)) as event_id from u join e using (chapter) where contains(a, b) or contains(b, a) group by all) select u.chapter, u.update_id, event_id from u left join m using (chapter, update_id)""")
def linked_updates(spark, sf):
    p, key = bind.table(spark, sf, "part"), F.col("p_partkey")
    updates = p.where("p_partkey % 3 = 0").select((key % 40).alias("chapter"), key.alias("update_id"), F.col("p_name").alias("event_text"))
    events = p.where("p_partkey % 3 <> 0").select((key % 40).alias("chapter"), key.alias("event_id"), key.alias("seq"), F.when(key % 2 == 0, F.col("p_name")).otherwise(F.substring_index("p_name", " ", 1)).alias("description"))
    return ingest.link_thread_events(updates, events, ["chapter"]).select("chapter", "update_id", "event_id")


@query(f"with {VERSIONS}, x as (select v.*, case when row % 10 = 1 then row - 1 else row end as t, row % 10 <> 1 as own from v) select t as row, chapter, status, price from x qualify row_number() over (partition by t, chapter order by own desc, status is null) = 1")
def repaired_history(spark, sf):
    """Versions of rows merged into their neighbour."""
    versions = bind.versions(spark, sf).drop("novel")
    merges = versions.select("row").distinct().where("row % 10 = 1").select(F.col("row").alias("source"), (F.col("row") - 1).alias("target"))
    return records.payload(entity.repair_history(versions, merges, []))


@query("with recursive m as (select s_suppkey as source, s_suppkey - 1 as target from supplier where s_suppkey % 8 <> 0), r as (select source, target from m union all select r.source, m.target from r join m on r.target = m.source) select source, min(target) as target from r group by 1")
def merge_roots(spark, sf):
    """Chains of merges followed to their ends."""
    merges = bind.table(spark, sf, "supplier").where("s_suppkey % 8 <> 0").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") - 1).alias("target"))
    return entity.merge_roots(merges)


@query(f"with {VERSIONS} select row, novel, (max(chapter) filter (status is not null)) is not null as alive from v group by all")
def living_rows(spark, sf):
    rows = asof.latest_before(bind.versions(spark, sf).where("payload is not null"), ["row", "novel"], ["chapter"], ["chapter"])
    every = bind.versions(spark, sf).select("row", "novel").distinct()
    return every.join(rows, ["row", "novel"], "left").select("row", "novel", F.col("chapter").isNotNull().alias("alive"))
