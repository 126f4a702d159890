"""As-of views for readers, composed of the operators: pages of chapters, characters, places, things, facts and search."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreframe.functions import text as X
from loreframe.operators import asof, folds, ingest, reads
from loreframe.plans import bind, graph, records, story
from loreframe.plans.bind import ASSERTED, CHAPTERS, DELTAS, HELD, LOCATED, RELATIONS

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


CUTS = "k(cutoff) as (values (5), (15), (25))"


@query(f"with {CHAPTERS}, f as (select doc_id, count(*) as findings, count_if(quality = 0) as fails from labels group by 1), k(cutoff) as (values (10), (30)) select novel, number, cutoff, coalesce(findings, 0) as findings, coalesce(fails, 0) as fails from c left join f using (doc_id), k where number <= cutoff")
def chapter_list(spark, sf):
    """Chapters up to each cutoff with counts of their findings."""
    counts = bind.table(spark, sf, "labels").groupBy("doc_id").agg(F.count("*").alias("findings"), F.count_if(F.col("quality") == 0).alias("fails"))
    rows = bind.chapters(spark, sf).select("novel", "number", "doc_id").crossJoin(F.broadcast(spark.createDataFrame([(10,), (30,)], "cutoff int"))).where("number <= cutoff")
    return rows.join(counts, "doc_id", "left").fillna(0, ["findings", "fails"]).select("novel", "number", "cutoff", "findings", "fails")


@query("with s as (select conv_id as chapter, row_number() over (partition by conv_id order by turn) - 1 as scene_index, turn, role, text from conversations), n as (select c_custkey as id, c_name as name from customer where c_custkey % 3 <> 0) select chapter, scene_index, coalesce(p.name, chapter::varchar) as pov, coalesce(l.name, (turn + 7)::varchar) as place, length(text) as n_chars from s left join n p on p.id = chapter left join n l on l.id = turn + 7")
def scene_list(spark, sf):
    """Scenes with the names of their points of view and places, or the ids where those are unknown."""
    index = F.row_number().over(W.partitionBy("chapter").orderBy("turn")) - 1
    rows = bind.table(spark, sf, "conversations").select(F.col("conv_id").alias("chapter"), "turn", "text").withColumn("scene_index", index)
    names = bind.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    pov, place = names.select(F.col("id").alias("chapter"), F.col("name").alias("_p")), names.select((F.col("id") - 7).alias("turn"), F.col("name").alias("_l"))
    met = rows.join(pov, "chapter", "left").join(place, "turn", "left")
    return met.select("chapter", "scene_index", F.coalesce("_p", F.col("chapter").cast("string")).alias("pov"), F.coalesce("_l", (F.col("turn") + 7).cast("string")).alias("place"), F.length("text").cast("long").alias("n_chars"))


@query("select chapter, text, row_number() over (partition by chapter order by turn) - 1 as scene_index from (select conv_id as chapter, turn, text from conversations where text is null or text = '' union all select conv_id, min(turn), text from conversations where text <> '' group by conv_id, text)")
def deduped_scenes(spark, sf):
    """Scenes with one opening are one, empty openings aside; then numbered anew."""
    rows = bind.table(spark, sf, "conversations").select(F.col("conv_id").alias("chapter"), "turn", "text")
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    kept = rows.where(empty).unionByName(folds.dedupe_first(rows.where(~empty), ["chapter", "text"], ["turn"]))
    return kept.select("chapter", "text", (F.row_number().over(W.partitionBy("chapter").orderBy("turn")) - 1).alias("scene_index"))


@query(f"""with {DELTAS}, {LOCATED}, {HELD}, {CUTS}, first as (select novel, entity, min(chapter) as first from d group by all), f as (select * from first, k where first <= cutoff),
st as (select novel, entity, cutoff, arg_max(location, (chapter, ordinal)) as location, max(chapter) as last_chapter, count(distinct chapter) as n_history from d, k where chapter <= cutoff group by all),
h as (select novel, entity, cutoff, count(*) as n_held from pos, k where since <= cutoff and (until is null or until > cutoff) group by all)
select f.novel, f.entity, f.cutoff, first as first_chapter, location, last_chapter, n_history, coalesce(n_held, 0) as n_held from f join st using (novel, entity, cutoff) left join h using (novel, entity, cutoff)""")
def character_pages(spark, sf):
    """Each entity at each cutoff after its first appearance: current state, length of its history, things held."""
    cuts, log = story.cutoffs(spark), bind.deltas(spark, sf)
    first = log.groupBy("novel", "entity").agg(F.min("chapter").alias("first_chapter"))
    seen = first.crossJoin(F.broadcast(cuts)).where(asof.seen_by("first_chapter", "cutoff"))
    state = log.crossJoin(F.broadcast(cuts)).where("chapter <= cutoff").groupBy("novel", "entity", "cutoff").agg(F.max_by("location", F.struct("chapter", "ordinal")).alias("location"), F.max("chapter").alias("last_chapter"), F.count_distinct("chapter").alias("n_history"))
    held = story.possessions_at_cutoffs(spark, sf).groupBy("novel", "entity", "cutoff").agg(F.count("*").alias("n_held"))
    key = ["novel", "entity", "cutoff"]
    return seen.join(state, key).join(held, key, "left").fillna(0, ["n_held"]).select(*key, "first_chapter", "location", "last_chapter", "n_history", "n_held")


@query(f"with {DELTAS}, {LOCATED}, {CUTS}, s as (select novel, location, cutoff, count(distinct entity) as n_seen, string_agg(distinct entity, ',' order by entity) as seen from loc, k where since <= cutoff group by all), e as (select novel, location, cutoff, count(*) as n_events from d, k where chapter <= cutoff group by all) select * from s join e using (novel, location, cutoff)")
def location_pages(spark, sf):
    """Each place at each cutoff: its events and who was seen there."""
    cuts, key = story.cutoffs(spark), ["novel", "location", "cutoff"]
    seen = story.location_edges(spark, sf).crossJoin(F.broadcast(cuts)).where("since <= cutoff").groupBy(*key).agg(F.array_sort(F.collect_set("entity")).alias("s"))
    events = bind.deltas(spark, sf).crossJoin(F.broadcast(cuts)).where("chapter <= cutoff").groupBy(*key).agg(F.count("*").alias("n_events"))
    return seen.join(events, key).select(*key, F.size("s").cast("long").alias("n_seen"), F.array_join(F.col("s").cast("array<string>"), ",").alias("seen"), "n_events")


@query(f"with {RELATIONS}, c(cutoff) as (values (12), (36), (60)), a as (select b as object, cutoff, id, a from r, c where greatest(coalesce(from_chapter, 0), coalesce(asserted, 0)) <= cutoff and (to_chapter is null or to_chapter >= cutoff) and not exists (select 1 from r n where n.id = r.successor and coalesce(n.asserted, n.from_chapter, 0) <= cutoff)) select object, cutoff, count(*) as n_relations, min(s_name) as first_name from a join supplier on s_suppkey = a group by all")
def object_pages(spark, sf):
    """Things at cutoffs with their active relationships and the first name on the other side."""
    edges = reads.oriented_edges(graph.active_relationships(spark, sf).select("a", "b", "id", "cutoff")).where("not outgoing")
    names = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("other"), F.col("s_name").alias("name"))
    return edges.join(names, "other").groupBy(F.col("entity").alias("object"), "cutoff").agg(F.count("*").alias("n_relations"), F.min("name").alias("first_name"))


@query("with e as (select l_orderkey as event, min((year(l_shipdate) - 1995) * 12 + month(l_shipdate))::int as chapter, list(distinct l_suppkey) as m from lineitem group by 1), k(cutoff) as (values (12), (36), (60)) select s_suppkey as faction, cutoff, count(event) as n_events from supplier join k on true left join e on list_contains(m, s_suppkey) and chapter <= cutoff group by all having count(event) > 0")
def faction_pages(spark, sf):
    """Factions that some event up to the cutoff involves, by array membership as an equi-join."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    events = bind.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.min(month).alias("chapter"), F.collect_set("l_suppkey").alias("m"))
    each = events.select("event", "chapter", F.explode("m").alias("faction")).crossJoin(F.broadcast(graph.cutoffs(spark))).where("chapter <= cutoff")
    own = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("faction"))
    return each.join(own, "faction").groupBy("faction", "cutoff").agg(F.count("*").alias("n_events"))


@query(f"with {RELATIONS}, f as (select b as entity, min(asserted) as first from r group by 1), c(cutoff) as (values (12), (36), (60)) select p_type as entity_type, cutoff, count(*) as n_visible from part left join f on f.entity = p_partkey + 1000000000, c where coalesce(first, 0) <= cutoff group by all")
def custom_entity_counts(spark, sf):
    """Visible custom entities of each registered type at cutoffs."""
    kinds = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_type").alias("entity_type"))
    return graph.visible_by_reference(spark, sf).join(kinds, "entity").groupBy("entity_type", "cutoff").agg(F.count("*").alias("n_visible"))


@query(f"with {DELTAS}, {ASSERTED}, {CUTS} select ae.novel, ae.entity, ae.id, text, learned, cutoff from ae, k where learned <= cutoff and not (expires is not null and expires <= cutoff) and contains(lower(text), lower('7'))")
def knows_edges(spark, sf):
    """Facts known at cutoffs that contain a text, those whose replacement has been learnt left out."""
    facts = bind.assertions(spark, sf)
    live = asof.unsuperseded(facts, story.cutoffs(spark), "id", "successor", F.col("learned"))
    return live.where("learned <= cutoff").where(F.contains(F.lower("text"), F.lower(F.lit("7")))).select("novel", "entity", "id", "text", "learned", "cutoff")


@query(f"with {records._CANON} select subject, value, confidence, c_name as name from cf left join customer on c_custkey = subject and c_custkey % 2 = 0 where locked")
def locked_canon(spark, sf):
    """Locked facts with the names of their subjects."""
    names = bind.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject"), F.col("c_name").alias("name"))
    return records.canon_facts(spark, sf).where("locked").join(names, "subject", "left").select("subject", "value", "confidence", "name").orderBy(F.col("name").asc_nulls_last(), "subject")


@query("with s as (select l_orderkey % 10 as novel, least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b, l_linenumber as chapter from lineitem where l_suppkey <> l_partkey group by all), k(cutoff) as (values (2), (4)) select novel, a, b, cutoff, count(*) as n from s, k where chapter <= cutoff group by all")
def dynamics_at_cutoffs(spark, sf):
    rows = graph.shared_dynamics(spark, sf).crossJoin(F.broadcast(spark.createDataFrame([(2,), (4,)], "cutoff int"))).where("chapter <= cutoff")
    return rows.groupBy("novel", "a", "b", "cutoff").agg(F.count("*").alias("n"))


@query(f"""with {DELTAS}, {ASSERTED}, {CUTS}, {records._CANON}, {records._COMMIT}
select 'knowledge' as kind, ae.id as item, cutoff, entity || ' knows: ' || text as snippet from ae, k where learned <= cutoff and (expires is null or expires > cutoff)
union all select 'canon', subject, cutoff, subject || ' is ' || value from cf, k where seq % 30 <= cutoff
union all select 'commitment', id, cutoff, 'planted ' || foreshadow_chapter || case when payoff_chapter <= 1990 + cutoff then ', paid' else '' end from cm, k where foreshadow_chapter <= 1990 + cutoff""")
def fact_candidates(spark, sf):
    """What can be found at each cutoff: knowledge, canon and commitments, each as of it, as one list of snippets."""
    cuts = F.broadcast(story.cutoffs(spark))
    facts = asof.unsuperseded(bind.assertions(spark, sf), story.cutoffs(spark), "id", "successor", F.col("learned")).where("learned <= cutoff")
    known = facts.select(F.lit("knowledge").alias("kind"), F.col("id").alias("item"), "cutoff", F.concat(F.col("entity").cast("string"), F.lit(" knows: "), "text").alias("snippet"))
    canon = records.canon_facts(spark, sf).crossJoin(cuts).where("seq % 30 <= cutoff").select(F.lit("canon").alias("kind"), F.col("subject").alias("item"), "cutoff", F.concat_ws(" is ", F.col("subject").cast("string"), "value").alias("snippet"))
    late = F.col("cutoff") + 1990
    plans = records.commitments(spark, sf).crossJoin(cuts).where(F.col("foreshadow_chapter") <= late)
    paid = F.when(asof.masked("payoff_chapter", late).isNotNull(), ", paid").otherwise("")
    plans = plans.select(F.lit("commitment").alias("kind"), F.col("id").alias("item"), "cutoff", F.concat(F.lit("planted "), F.col("foreshadow_chapter").cast("string"), paid).alias("snippet"))
    return known.unionByName(canon).unionByName(plans)


@query("with x as (select conv_id as chapter, turn, role as source_type, case when conv_id % 3 = 0 then 'HIGH' when conv_id % 3 = 1 then 'low' else 'unsure' end as certainty from conversations), n as (select c_custkey as id from customer where c_custkey % 2 = 0) select chapter, turn, case when source_type in ('user', 'assistant') then source_type else 'other' end as source_type, case lower(certainty) when 'high' then 1.0 when 'low' then 0.3 else 1.0 end::double as certainty from x join n on n.id = chapter")
def learnt_facts(spark, sf):
    """Knowledge rows of known characters only, with whitelisted sources and numeric certainty."""
    from loreframe.functions import text as X

    certainty = F.when(F.col("conv_id") % 3 == 0, "HIGH").when(F.col("conv_id") % 3 == 1, "low").otherwise("unsure")
    rows = bind.table(spark, sf, "conversations").select(F.col("conv_id").alias("chapter"), "turn", "role", certainty.alias("c"))
    known = bind.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("chapter"))
    source = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("other")
    return rows.join(known, "chapter", "left_semi").select("chapter", "turn", source.alias("source_type"), F.coalesce(X.level("c"), F.lit(1.0)).alias("certainty"))


@query("with e as (select distinct l_partkey as p from lineitem where l_returnflag = 'R'), a as (select distinct l_partkey as p from lineitem where l_returnflag = 'A') select 'missing' as kind, count(*) as n from e where p not in (select p from a) union all select 'extra', count(*) from a where p not in (select p from e) union all select 'found', count(*) from e where p in (select p from a)")
def set_differences(spark, sf):
    """Expected against actual sets by semi and anti joins."""
    lines = bind.table(spark, sf, "lineitem")
    e, a = (lines.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("p")).distinct() for x in "RA")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(e.join(a, "p", "left_anti"), "missing").unionByName(count(a.join(e, "p", "left_anti"), "extra")).unionByName(count(e.join(a, "p", "left_semi"), "found"))


@query("select event_id, json_merge_patch(props, '{\"seen\":true}')->>'$.k' as k, 'event ' || event_type || ' ' || round(value)::int as snippet from events")
def built_records(spark, sf):
    """JSON built, merged and read back; snippets by concatenation."""
    record = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit(True).alias("seen")))
    return bind.table(spark, sf, "events").select("event_id", F.get_json_object(record, "$.k").alias("k"), F.concat_ws(" ", F.lit("event"), "event_type", F.round("value").cast("int").cast("string")).alias("snippet"))


@query("""with x as (select event_id, json_merge_patch(props, case when event_id % 3 = 0 then '{"seen": true, "k": "new", "list": [1, {"a": 2}]}' when event_id % 3 = 1 then '{"seen": false}' else '{}' end) as j from events) select event_id, j->>'$.k' as k, j->>'$.seen' as seen, j->>'$.list[1].a' as inner_a, len(json_keys(j)) as n from x""")
def merged_json(spark, sf):
    """Objects put over each other: a value is replaced, added or kept, nested ones whole."""
    patch = F.when(F.col("event_id") % 3 == 0, '{"seen": true, "k": "new", "list": [1, {"a": 2}]}').when(F.col("event_id") % 3 == 1, '{"seen": false}').otherwise("{}")
    rows = bind.table(spark, sf, "events").select("event_id", X.merge_json("props", patch).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    return rows.select("event_id", at("$.k").alias("k"), at("$.seen").alias("seen"), at("$.list[1].a").alias("inner_a"), F.size(F.json_object_keys("j")).cast("long").alias("n"))


@query(f"with {DELTAS}, m as (select d.*, (select max(chapter) from d) as horizon from d) select novel, horizon, count_if(chapter = horizon) as n_last, count(*) as n from m group by all")
def horizon_counts(spark, sf):
    """A join with a one-row table."""
    log = bind.deltas(spark, sf)
    horizon = F.broadcast(log.agg(F.max("chapter").alias("horizon")))
    return log.crossJoin(horizon).groupBy("novel", "horizon").agg(F.count_if(F.col("chapter") == F.col("horizon")).alias("n_last"), F.count("*").alias("n"))


@query("select l_orderkey as event, count(distinct l_suppkey) as n_members from lineitem group by 1 having bool_or(l_suppkey = 7)")
def contained_members(spark, sf):
    """Events whose members hold an id."""
    return graph.events(spark, sf).where(F.array_contains("members", F.lit(7).cast("long"))).select("event", F.size("members").cast("long").alias("n_members"))


@query("select o_custkey as novel, count(*) as n_kept, min(o_orderkey) as first from orders where o_orderkey % 4 <> 0 group by 1")
def scanned_with_predicates(spark, sf):
    rows = bind.table(spark, sf, "orders").select(F.col("o_custkey").alias("novel"), "o_orderkey").where("o_orderkey % 4 <> 0")
    return ingest.merge_entities(rows.withColumn("key", F.col("o_orderkey")), ["novel"], "key", ["o_orderkey"], []).join(rows.groupBy("novel").agg(F.count("*").alias("n_kept")), "novel").select("novel", "n_kept", F.col("o_orderkey").alias("first"))
