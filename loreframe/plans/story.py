"""Queries over the event log: cutoffs, folds, intervals, snapshots, knowledge and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.operators import asof, checks, folds, ingest, metrics
from loreframe.plans import bind
from loreframe.plans.bind import ASSERTED, DELTAS, HELD, LOCATED

QUERIES, ORACLES = {}, {}
CUTOFFS = (5, 15, 25)


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def cutoffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff int")


CUTS = "k(cutoff) as (values (5), (15), (25))"


@query(f"with {DELTAS}, {LOCATED}, {CUTS} select novel, entity, cutoff, location, since, case when until <= cutoff then until end as until from loc, k where since <= cutoff and (until is null or until >= cutoff) and not exists (select 1 from loc n where n.id = loc.superseded_by and n.since <= cutoff)")
def located_at_cutoffs(spark, sf):
    held = folds.located(folds.location_edges(bind.deltas(spark, sf)), cutoffs(spark))
    return held.select("novel", "entity", "cutoff", "location", "since", asof.masked("until", "cutoff").alias("until"))


@query(f"with {DELTAS}, {LOCATED} select * from loc")
def location_edges(spark, sf):
    return folds.location_edges(bind.deltas(spark, sf))


@query(f"with {DELTAS}, {HELD} select * from pos")
def possession_edges(spark, sf):
    return folds.possession_edges(bind.deltas(spark, sf).where("change is not null"))


@query(f"with {DELTAS}, {HELD}, {CUTS} select novel, entity, object, cutoff, since from pos, k where since <= cutoff and (until is null or until > cutoff)")
def possessions_at_cutoffs(spark, sf):
    edges = possession_edges(spark, sf).crossJoin(F.broadcast(cutoffs(spark)))
    return edges.where(asof.within("since", "until", "cutoff", loses_at_end=True)).select("novel", "entity", "object", "cutoff", "since")


@query(f"with {DELTAS}, {HELD}, {CUTS} select novel, entity, object, cutoff as chapter from pos, k where since < cutoff and (until is null or until >= cutoff)")
def held_entering_chapter(spark, sf):
    edges = possession_edges(spark, sf).crossJoin(F.broadcast(cutoffs(spark)))
    return edges.where(asof.held_entering("since", "until", "cutoff")).select("novel", "entity", "object", F.col("cutoff").alias("chapter"))


@query(f"with {DELTAS}, k(novel, asked) as (values (0, 5), (1, null), (2, 40), (11, 3), (12, null)), l as (select novel, max(chapter) as last from d group by 1) select k.novel::bigint as novel, coalesce(asked, last, 0) as cutoff, coalesce(last, 0) as last, coalesce(asked, last, 0) >= coalesce(last, 0) as uncapped from k left join l on k.novel = l.novel")
def cutoffs_resolved(spark, sf):
    asked = spark.createDataFrame([(0, 5), (1, None), (2, 40), (11, 3), (12, None)], "novel long, cutoff int")
    return asof.resolve_cutoff(bind.deltas(spark, sf), asked)


@query(f"""with {DELTAS}, {ASSERTED} select novel, entity, chapter, 0 as phase, ordinal, 'move' as kind, location as value from d
union all select novel, entity, learned, 1, id, 'learn', text from a union all select novel, entity, expires, 2, id, 'expire', text from ae where expires is not null""")
def state_events(spark, sf):
    own = bind.deltas(spark, sf).select("novel", "entity", "chapter", "ordinal", F.lit("move").alias("kind"), F.col("location").alias("value"))
    return folds.state_events(own, bind.assertions(spark, sf))


_LAST = ", ".join(f"arg_max(value, ordinal) filter (attribute = '{a}') as {a}" for a in ("goals", "physical_state", "appearance", "emotional_state", "notes"))
_CARRY = ", ".join(f"last_value({a} ignore nulls) over (partition by novel, entity order by chapter rows unbounded preceding) as {a}" for a in ("location", "goals", "physical_state", "appearance"))


@query(f"with {DELTAS}, s as (select novel, entity, chapter, arg_max(location, ordinal) as location, {_LAST} from d group by all) select novel, entity, chapter, {_CARRY}, emotional_state, notes from s")
def state_snapshots(spark, sf):
    log = bind.deltas(spark, sf)
    rows = log.select("novel", "entity", "chapter", "ordinal", "attribute", "value").unionByName(log.select("novel", "entity", "chapter", "ordinal", F.lit("location").alias("attribute"), F.col("location").alias("value")))
    return folds.state_snapshots(rows)


@query(f"""with {DELTAS}, {ASSERTED}, p as (select novel, entity, learned as chapter from a union select novel, entity, expires from ae where expires is not null),
f as (select p.novel, p.entity, p.chapter, text, min((learned, id)) as t0 from p join ae on p.novel = ae.novel and p.entity = ae.entity and learned <= p.chapter and (expires is null or expires > p.chapter) group by all)
select novel, entity, chapter, string_agg(text, '|' order by t0) as knowledge from f group by all""")
def knowledge_sets(spark, sf):
    facts = bind.assertions(spark, sf)
    ends = folds.expiries(facts).where("expires is not null").select("novel", "entity", F.col("expires").alias("chapter"))
    points = facts.select("novel", "entity", F.col("learned").alias("chapter")).unionByName(ends)
    return folds.knowledge_sets(facts, points).withColumn("knowledge", F.array_join("knowledge", "|"))


@query(f"""with {DELTAS}, {LOCATED}, p as (select distinct novel, entity, chapter from d)
select p.novel, p.entity, p.chapter, arg_max(location, (since, id)) as location from p join loc on p.novel = loc.novel and p.entity = loc.entity and since <= p.chapter and (until is null or until >= p.chapter) group by all""")
def assembled_history(spark, sf):
    points = bind.deltas(spark, sf).select("novel", "entity", "chapter").distinct()
    return folds.assemble_history(location_edges(spark, sf), points)


@query(f"with {DELTAS}, m as (select novel, max(chapter) as last from d group by 1) select d.novel, chapter, ordinal from d join m using (novel) where chapter between greatest(last - 2, 1) and last qualify row_number() over (partition by d.novel order by chapter desc, ordinal desc) <= 200")
def recent_events(spark, sf):
    log = bind.deltas(spark, sf)
    last = log.groupBy("novel").agg(F.max("chapter").alias("last"))
    rows = log.join(F.broadcast(last), "novel").where(F.col("chapter").between(F.greatest(F.col("last") - 2, F.lit(1)), F.col("last")))
    return asof.topk(rows, ["novel"], [F.desc("chapter"), F.desc("ordinal")], 200).select("novel", "chapter", "ordinal")


@query(f"with {DELTAS}, {CUTS} select novel, entity, cutoff, arg_max(chapter, (chapter, ordinal)) as chapter, arg_max(location, (chapter, ordinal)) as location, arg_max(value, (chapter, ordinal)) as value from d, k where chapter < cutoff group by novel, entity, cutoff")
def latest_state_before(spark, sf):
    rows = bind.deltas(spark, sf).crossJoin(F.broadcast(cutoffs(spark))).where("chapter < cutoff")
    return asof.latest_before(rows, ["novel", "entity", "cutoff"], ["chapter", "ordinal"], ["chapter", "location", "value"])


@query(f"with {DELTAS} select novel, max(chapter) as through_chapter, count(*) as n_deltas, count(distinct entity) as n_entities from d group by 1")
def run_log(spark, sf):
    return ingest.run_log(bind.deltas(spark, sf))


@query(f"with {DELTAS.replace('from events)', 'from events where not (user_id % 10 = 3 and day(ts) >= 12))')}, {LOCATED} select * from loc")
def retcon_rebuild(spark, sf):
    """Novel 3 is rewound to before chapter 12 and rebuilt; the others stay."""
    return folds.location_edges(ingest.rewind(bind.deltas(spark, sf), spark.createDataFrame([(3, 12)], "novel long, from_chapter int")))


@query(f"""with {DELTAS}, x as (select ordinal, change, location, attribute, amount,
  case when location not in ('purchase','error','view') then 'unknown kind' when location in ('purchase','error') and object is null then 'no object'
       when location in ('purchase','error') and change not in ('gain','loss') then 'bad change' when location = 'view' and attribute not in ('goals','physical_state','appearance','emotional_state') then 'bad attribute' end as reason from d)
select ordinal, reason from x""")
def clean_deltas(spark, sf):
    kind = F.when(F.col("location").isin("purchase", "error"), "possession").when(F.col("location") == "view", "status").otherwise("other")
    rows = bind.deltas(spark, sf).withColumn("kind", kind)
    return ingest.clean_deltas(rows).select("ordinal", "reason")


@query("""select event_id as row_id, 'value' as field, 'range' as rule from events where not (value between 1 and 300)
union all select event_id, 'event_type', 'enum' from events where event_type not in ('click','view','purchase')
union all select event_id, 'props', 'required' from events where event_type = 'error' and (props->>'$.k')::bigint < 10""")
def contract_violations(spark, sf):
    rows = bind.table(spark, sf, "events")
    rules = {
        ("value", "range"): F.col("value").between(1, 300),
        ("event_type", "enum"): F.col("event_type").isin("click", "view", "purchase"),
        ("props", "required"): (F.col("event_type") != "error") | (F.get_json_object("props", "$.k").cast("long") >= 10),
    }
    return ingest.contract_violations(rows, "event_id", rules)


@query(f"with {DELTAS}, {HELD} select d.novel, d.entity, d.object, d.chapter, d.ordinal from d where location = 'click' and not exists (select 1 from pos where pos.novel = d.novel and pos.entity = d.entity and pos.object = d.object and since < d.chapter and (until is null or until >= d.chapter))")
def check_possession(spark, sf):
    claims = bind.deltas(spark, sf).where("location = 'click'").select("novel", "entity", "object", "chapter", "ordinal")
    return checks.check_possession(claims, possession_edges(spark, sf), ["novel", "entity", "object"])


@query(f"""with {DELTAS}, {HELD}, act as (select novel, entity, object, since + (id % 3)::int as since, until from pos),
m as (select p.id, bool_or(abs(p.since - t.since) <= 1 and ((p.until is null and t.until is null) or abs(p.until - t.until) <= 1)) as ok from pos p left join act t using (novel, entity, object) group by 1)
select count(*) as expected, count_if(coalesce(ok, false)) as matched, round(count_if(coalesce(ok, false)) / count(*), 9) as recall from m""")
def interval_recall(spark, sf):
    edges = possession_edges(spark, sf)
    actual = edges.select("novel", "entity", "object", (F.col("since") + (F.col("id") % 3).cast("int")).alias("since"), "until")
    return metrics.score_intervals(edges, actual, ["novel", "entity", "object"], 1)


@query(f"with {DELTAS}, {LOCATED}, {CUTS} select novel, location, cutoff, count(distinct entity) as seen from loc, k where since <= cutoff group by all")
def seen_at_location(spark, sf):
    rows = location_edges(spark, sf).crossJoin(F.broadcast(cutoffs(spark))).where("since <= cutoff")
    return rows.select("novel", "location", "cutoff", "entity").distinct().groupBy("novel", "location", "cutoff").agg(F.count("*").alias("seen"))


@query(f"with {DELTAS}, {LOCATED} select novel, entity, id, location, since, case when until <= 15 then until end as until from loc where since <= 15 and contains(lower(location), lower('VIE'))")
def location_history_filtered(spark, sf):
    rows = location_edges(spark, sf).where("since <= 15").where(F.contains(F.lower("location"), F.lower(F.lit("VIE"))))
    return rows.select("novel", "entity", "id", "location", "since", asof.masked("until", F.lit(15)).alias("until"))


@query(f"with {DELTAS} select novel, entity, chapter, row_number() over (partition by novel, entity, chapter order by ordinal) - 1 as scene_index, ordinal from d")
def renumbered_scenes(spark, sf):
    n = F.row_number().over(W.partitionBy("novel", "entity", "chapter").orderBy("ordinal")) - 1
    return bind.deltas(spark, sf).select("novel", "entity", "chapter", n.alias("scene_index"), "ordinal")
