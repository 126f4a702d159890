"""Queries over relationships, events' participants and entity merges (lineitem, supplier, part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreframe.functions import text as X
from loreframe.operators import asof, entity, folds, ingest, reads
from loreframe.plans import bind
from loreframe.plans.bind import RELATIONS

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


CUTS = "k(cutoff) as (values (12), (36), (60))"
_ACTIVE = "act as (select r.*, cutoff from r, k where greatest(coalesce(from_chapter, 0), coalesce(asserted, 0)) <= cutoff and (to_chapter is null or to_chapter >= cutoff) and not exists (select 1 from r n where n.id = r.successor and coalesce(n.asserted, n.from_chapter, 0) <= cutoff))"


def cutoffs(spark):
    return spark.createDataFrame([(12,), (36,), (60,)], "cutoff int")


@query(f"with {RELATIONS}, {CUTS}, {_ACTIVE} select id, cutoff, a, b, rel_type, case when to_chapter <= cutoff then to_chapter end as to_chapter from act")
def active_relationships(spark, sf):
    rows = reads.active_relationships(bind.relations(spark, sf), cutoffs(spark))
    return rows.select("id", "cutoff", "a", "b", "rel_type", asof.masked("to_chapter", "cutoff").alias("to_chapter"))


@query(f"with {RELATIONS}, {CUTS}, {_ACTIVE}, o as (select a as entity, b as other, true as outgoing, id, cutoff from act union all select b, a, false, id, cutoff from act) select entity, cutoff, count(*) as degree, count_if(outgoing) as outgoing, min(other) as first_other from o group by all")
def relationship_degrees(spark, sf):
    edges = reads.oriented_edges(active_relationships(spark, sf).select("a", "b", "id", "cutoff"))
    return edges.groupBy("entity", "cutoff").agg(F.count("*").alias("degree"), F.count_if("outgoing").alias("outgoing"), F.min("other").alias("first_other"))


@query(f"with {RELATIONS}, {CUTS}, {_ACTIVE} select cutoff, s_suppkey as entity, s_name as name from supplier, k where exists (select 1 from act where act.cutoff = k.cutoff and a = s_suppkey)")
def relationship_graph_nodes(spark, sf):
    """Nodes that have an edge at the cutoff."""
    nodes = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))
    ends = active_relationships(spark, sf).select("cutoff", F.col("a").alias("entity")).distinct()
    return ends.join(nodes, "entity").select("cutoff", "entity", "name")


def events(spark, sf):
    lines = bind.dealt(bind.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), "l_suppkey", "l_partkey"), "event")
    return lines.groupBy("event").agg(F.array_sort(F.collect_set("l_suppkey")).alias("members"), F.array_sort(F.collect_set(F.col("l_partkey") + 1_000_000_000)).alias("parts"))


_PAIRS = "p as (select distinct l_orderkey as event, l_suppkey as s from lineitem), co as (select x.event, x.s as a, y.s as b from p x join p y on x.event = y.event and x.s < y.s)"


@query(f"with {_PAIRS} select a, b, count(*) as n_events, min(event) as first_event from co group by all")
def cooccurrence_graph(spark, sf):
    return reads.cooccurrence_edges(events(spark, sf)).groupBy("a", "b").agg(F.count("*").alias("n_events"), F.min("event").alias("first_event"))


@query("select l_suppkey as a, l_partkey + 1000000000 as b, count(distinct l_orderkey) as n_events from (select distinct l_orderkey, s.l_suppkey, l_partkey from (select distinct l_orderkey, l_suppkey from lineitem) s join (select distinct l_orderkey, l_partkey from lineitem) q using (l_orderkey)) group by all")
def cross_cooccurrence(spark, sf):
    return reads.cross_edges(events(spark, sf), "members", "parts").groupBy("a", "b").agg(F.count("*").alias("n_events"))


_STORY = f"""with {_PAIRS}, {RELATIONS}, e as (select event % 4 as novel, a, b, 'event' as source, 'event ' || event % 3 as label, event as seq from co
union all select id % 4, a, b, 'possession', 'holds ' || rel_type, id from r where to_chapter is not null union all select id % 4, b, a, 'dynamic', 'tension ' || rel_type, id from r where id % 10 = 1),
f as (select novel, least(a, b) as a, greatest(a, b) as b, case source when 'dynamic' then 0 when 'event' then 1 when 'possession' then 2 else 3 end as k, source, label, seq from e),
l as (select novel, a, b, label, min((k, seq)) as t0, min((k, source)) as s from f group by all)
select novel, a, b, (min(s))[2] as source, case when count(*) = 1 then min(label) else count(*) || ' kinds' end as label, string_agg(label, chr(10) order by t0, label) as tooltip from l group by all"""


@query(_STORY)
def story_graph(spark, sf):
    """Edges of three sources, collapsed by pair."""
    co = reads.cooccurrence_edges(events(spark, sf)).select((F.col("event") % 4).alias("novel"), "a", "b", F.lit("event").alias("source"), F.concat(F.lit("event "), (F.col("event") % 3).cast("string")).alias("label"), F.col("event").alias("seq"))
    r = bind.relations(spark, sf)
    edge = lambda a, b, source, said: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(source).alias("source"), F.concat(F.lit(said), "rel_type").alias("label"))
    # both kinds of edges from one pass over the relationships
    both = F.array_compact(F.array(F.when(F.col("to_chapter").isNotNull(), edge("a", "b", "possession", "holds ")), F.when(F.col("id") % 10 == 1, edge("b", "a", "dynamic", "tension "))))
    told = r.select((F.col("id") % 4).alias("novel"), F.explode(both).alias("e"), F.col("id").alias("seq")).select("novel", "e.a", "e.b", "e.source", "e.label", "seq")
    return reads.merge_story_edges(co.unionByName(told), ["novel"], ["seq"])


@query("select l_orderkey as event, string_agg(coalesce(p_name, l_partkey::varchar), '|' order by l_linenumber, l_partkey, l_suppkey) as names from lineitem left join part on l_partkey = p_partkey and p_partkey % 10 <> 0 group by 1")
def event_object_names(spark, sf):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"])
    rows = bind.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(ids.alias("ids"))
    names = bind.table(spark, sf, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return reads.resolve_array_names(rows, "event", "ids", names).withColumn("names", F.array_join("names", "|"))


@query("select o_orderkey as chapter, count(l_orderkey) as findings, coalesce(count_if(l_returnflag = 'R'), 0) as fails, coalesce(count_if(l_returnflag = 'A'), 0) as warns from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def critique_counts(spark, sf):
    lines = bind.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("findings"), F.count_if(F.col("l_returnflag") == "R").alias("fails"), F.count_if(F.col("l_returnflag") == "A").alias("warns"))
    out = bind.table(spark, sf, "orders").select(F.col("o_orderkey").alias("chapter")).join(lines, F.col("chapter") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return out.fillna(0, ["findings", "fails", "warns"])


@query("select l_partkey as object, count(distinct l_orderkey) as n_events, string_agg(distinct l_suppkey, ',' order by l_suppkey) as participants from lineitem group by 1")
def object_participants(spark, sf):
    rows = bind.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("object")).agg(F.count_distinct("l_orderkey").alias("n_events"), F.array_sort(F.collect_set("l_suppkey")).alias("participants"))
    return rows.withColumn("participants", F.array_join(F.col("participants").cast("array<string>"), ","))


@query("select s_suppkey as thread, coalesce(string_agg(l_orderkey || ':' || l_linenumber, '|' order by (year(l_shipdate) - 1995) * 12 + month(l_shipdate), l_orderkey * 10 + l_linenumber, l_orderkey || ':' || l_linenumber), '') as events from supplier left join lineitem on l_suppkey = s_suppkey group by 1")
def threads_with_events(spark, sf):
    threads = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("thread"))
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    rows = bind.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("thread"), month.alias("chapter"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("label"))
    return reads.threads_with_events(threads, rows, "thread").withColumn("events", F.array_join("events", "|"))


@query("select l_orderkey % 10 as novel, least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b, l_linenumber as chapter, string_agg(distinct l_returnflag || l_linestatus, ' ' order by l_returnflag || l_linestatus) as description from lineitem where l_suppkey <> l_partkey group by all")
def shared_dynamics(spark, sf):
    rows = bind.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("novel"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_linenumber").alias("chapter"), F.concat("l_returnflag", "l_linestatus").alias("description"))
    return ingest.dynamics(rows, ["description"])


@query(f"with {RELATIONS}, f as (select b as entity, min(asserted) as first from r group by 1), {CUTS} select p_partkey as entity, cutoff from part left join f on f.entity = p_partkey + 1000000000, k where coalesce(first, 0) <= cutoff")
def visible_by_reference(spark, sf):
    entities = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("entity"))
    refs = bind.relations(spark, sf).select((F.col("b") - 1_000_000_000).alias("entity"), F.col("asserted").alias("chapter"))
    return asof.visible_by_reference(entities, refs, cutoffs(spark)).select("entity", "cutoff")


@query(f"""with recursive {RELATIONS}, g as (select id % 4 as novel, a, b, case rel_type when 'A' then 'friend_of' when 'N' then ' Rival ' else 'mentor_of' end as rel_type, case when id % 3 = 0 then true when id % 3 = 1 then false end as stored, id from r)
select id, rel_type, coalesce(stored, lower(trim(rel_type)) in ('friend_of', 'rival')) as mutual from g""")
def symmetric_relationships(spark, sf):
    rows = bind.relations(spark, sf)
    label = F.when(F.col("rel_type") == "A", "friend_of").when(F.col("rel_type") == "N", " Rival ").otherwise("mentor_of")
    stored = F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False)
    return rows.select("id", label.alias("rel_type"), X.is_symmetric(label, stored).alias("mutual"))


def relationship_log(spark, sf):
    """Few suppliers on both sides, so that pairs repeat."""
    r = bind.relations(spark, sf)
    return r.select((F.col("id") % 2).alias("novel"), (F.col("a") % 30).alias("a"), ((F.col("b") - 1_000_000_000) % 30).alias("b"), "rel_type", (F.col("rel_type") == "A").alias("mutual"), "from_chapter", "to_chapter", F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).alias("notes"), F.col("id").alias("seq")).where("a <> b")


#: One assertion of every pair a step: f and b are the pair's active rows in either direction (seq, start, end, notes, mutual).
_FOLDED = f"""with recursive {RELATIONS}, lg as (select id % 2 as novel, a % 30 as a, (b - 1000000000) % 30 as b, rel_type, rel_type = 'A' as mutual, from_chapter, to_chapter, case when id % 5 = 0 then id::varchar end as notes, id as seq from r),
ln as (select *, least(a, b) as x, greatest(a, b) as y, a < b as fwd, row_number() over (partition by novel, rel_type, least(a, b), greatest(a, b) order by seq) as i from lg where a <> b),
st as (select 0::bigint as i, novel, rel_type, x, y, null::struct(s bigint, c0 int, c1 int, t varchar, m boolean) as f, null::struct(s bigint, c0 int, c1 int, t varchar, m boolean) as g, null::bigint as gone_f, null::bigint as gone_g, null::bigint as made from (select distinct novel, rel_type, x, y from ln)
 union all select i, novel, rel_type, x, y,
   case when act and fwd then {{'s': seq, 'c0': c0, 'c1': c1, 't': t, 'm': mutual}} when act and hit_f then null else f end,
   case when act and not fwd then {{'s': seq, 'c0': c0, 'c1': c1, 't': t, 'm': mutual}} when act and hit_g then null else g end,
   case when act and hit_f then f.s end, case when act and hit_g then g.s end, case when act then seq end
  from (select *, (not hit_f and not hit_g) or (to_chapter is not null and not coalesce(hit_f and f.c1 is not null, false) and not coalesce(hit_g and g.c1 is not null, false)) as act,
     case when lead_f then coalesce(f.c0, from_chapter) when hit_f or hit_g then coalesce(g.c0, from_chapter) else from_chapter end as c0, to_chapter as c1,
     case when lead_f then coalesce(notes, f.t) when hit_f or hit_g then coalesce(notes, g.t) else notes end as t
    from (select *, hit_f and (not hit_g or f.s < g.s) as lead_f from (select n.*, s.f, s.g, s.f is not null and (n.fwd or (n.mutual and s.f.m)) as hit_f, s.g is not null and (not n.fwd or (n.mutual and s.g.m)) as hit_g from st s join ln n on n.novel = s.novel and n.rel_type = s.rel_type and n.x = s.x and n.y = s.y and n.i = s.i + 1)))),
mk as (select l.novel, l.rel_type, l.seq, l.a, l.b, l.mutual, case when l.fwd then s.f.c0 else s.g.c0 end as from_chapter, l.to_chapter, case when l.fwd then s.f.t else s.g.t end as notes from st s join ln l on l.novel = s.novel and l.rel_type = s.rel_type and l.x = s.x and l.y = s.y and l.i = s.i where made is not null),
gn as (select gone_f as seq, made from st where gone_f is not null union all select gone_g, made from st where gone_g is not null)
select mk.*, gn.made as superseded_by from mk left join gn on gn.seq = mk.seq"""


@query(_FOLDED)
def folded_relationships(spark, sf):
    return folds.fold_relationships(relationship_log(spark, sf))


@query("with t as (select 'supplier' as entity_type, s_suppkey as entity, s_name as name from supplier union all select 'customer', c_custkey + 1000000, c_name from customer) select l_orderkey as event, l_linenumber as line, entity_type, name from lineitem left join t on entity = case when l_linenumber % 2 = 0 then l_suppkey else l_partkey % 1500 + 1000000 end")
def typed_lookup(spark, sf):
    entities = reads.typed_entities({
        "supplier": bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name")),
        "customer": bind.table(spark, sf, "customer").select((F.col("c_custkey") + 1_000_000).alias("entity"), F.col("c_name").alias("name")),
    })
    which = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).otherwise(F.col("l_partkey") % 1500 + 1_000_000)
    rows = bind.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("line"), which.alias("entity"))
    return rows.join(entities, "entity", "left").select("event", "line", "entity_type", "name")


_MAP = "mp as (select s_suppkey as source, s_suppkey - s_suppkey % 10 as target from supplier where s_suppkey % 10 in (1, 2))"


@query(f"""with {RELATIONS}, {_MAP}, x as (select id, coalesce(m1.target, a) as a, coalesce(m2.target, b) as b, rel_type, from_chapter, to_chapter from (select id, a, b - 1000000000 as b, rel_type, from_chapter, to_chapter from r) r left join mp m1 on a = m1.source left join mp m2 on b = m2.source)
select * from x where a <> b qualify row_number() over (partition by a, b, rel_type, from_chapter, to_chapter order by id) = 1""")
def merged_relationships(spark, sf):
    rows = bind.relations(spark, sf).select("id", "a", (F.col("b") - 1_000_000_000).alias("b"), "rel_type", "from_chapter", "to_chapter")
    merges = bind.table(spark, sf, "supplier").where("s_suppkey % 10 in (1, 2)").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") - F.col("s_suppkey") % 10).alias("target"))
    return entity.apply_merges(rows, merges, ["a", "b"], same=["a", "b", "rel_type", "from_chapter", "to_chapter"], order="id")


@query(f"with {_MAP}, e as (select distinct l_orderkey as event, coalesce(target, l_suppkey) as s from lineitem left join mp on l_suppkey = source) select event, string_agg(s, ',' order by s) as members from e group by 1")
def merged_members(spark, sf):
    """Array repointing by a join of exploded ids."""
    merges = bind.table(spark, sf, "supplier").where("s_suppkey % 10 in (1, 2)").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") - F.col("s_suppkey") % 10).alias("target"))
    rows = entity.repoint_arrays(events(spark, sf).select("event", "members"), "event", "members", merges)
    return rows.select("event", F.array_join(F.array_sort("members").cast("array<string>"), ",").alias("members"))


@query("with x as (select l_orderkey as event, list(distinct l_suppkey order by l_suppkey) as m, list(distinct l_partkey + 1000000000 order by l_partkey + 1000000000) as p from lineitem group by 1) select event, array_to_string(list_filter(m, lambda s: s <> 7), ',') as members, array_to_string(list_sort(list_distinct(case when list_contains(m, 7) then list_append(p, 5000000000) else p end)), ',') as parts from x")
def cross_type_merge(spark, sf):
    """Supplier 7 becomes part 5000000000: its involvement moves from one array to the other."""
    rows = entity.move_between(events(spark, sf), "members", "parts", F.lit(7).cast("long"), F.lit(5_000_000_000))
    return rows.select("event", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.array_join(F.array_sort("parts").cast("array<string>"), ",").alias("parts"))


@query(f"with {RELATIONS} select * from (select 'orders' as kind, l_orderkey as event, l_suppkey as a, l_partkey as b, o_totalprice as price, c_name as customer from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey and c_custkey % 3 = 0)")
def timeline(spark, sf):
    """Inner and left equi-joins of events, chapters and optional names."""
    lines, orders = bind.table(spark, sf, "lineitem"), bind.table(spark, sf, "orders")
    names = bind.table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer"))
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(names, "o_custkey", "left")
    return met.select(F.lit("orders").alias("kind"), F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("o_totalprice").alias("price"), "customer")
