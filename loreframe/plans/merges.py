"""A merge of suppliers over all tables that name them: one row of text for each row that stays, by table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreframe.operators import entity, identity
from loreframe.plans import bind
from loreframe.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


#: Of ten suppliers two are merged into the first, and one into the second of these.
_TO = "case s_suppkey % 10 when 1 then s_suppkey - 1 when 2 then s_suppkey - 2 when 3 then s_suppkey - 1 end"
_BASE = f"""mp0 as (select s_suppkey as source, {_TO} as target from supplier where s_suppkey % 10 in (1, 2, 3)), mp as (select a.source, coalesce(b.target, a.target) as target from mp0 a left join mp0 b on b.source = a.target),
ns as (select count(*) as n from supplier), en as (select s_suppkey as id, s_name as name, ['the ' || s_name, 'no ' || s_suppkey % 7] as aliases from supplier),
ln as (select l_orderkey * 10 + l_linenumber as id, l_suppkey as a, l_partkey % n as b, l_returnflag, l_linestatus, l_linenumber, l_quantity, l_orderkey from lineitem, ns qualify row_number() over (partition by l_orderkey, l_linenumber order by l_suppkey, l_partkey, l_returnflag, l_linestatus, l_quantity) = 1)"""


def base(spark, sf):
    """(merges, entities, lines): lines have one row an id, with suppliers a and b."""
    s = bind.table(spark, sf, "supplier")
    merges = files.stored(entity.merge_roots(s.where("s_suppkey % 10 in (1, 2, 3)").select(F.col("s_suppkey").alias("source"), F.expr(_TO).alias("target"))), "merges")
    entities = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("the "), "s_name"), F.concat(F.lit("no "), (F.col("s_suppkey") % 7).cast("string"))).alias("aliases"))
    n = F.broadcast(s.agg(F.count("*").alias("n")))
    first = F.min(F.struct("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")).alias("x")
    lines = bind.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "x.*").crossJoin(n)
    lines = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") % F.col("n")).alias("b"), "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_orderkey")
    return merges, entities, lines


_MOVE = "coalesce((select target from mp where source = {c}), {c})"


@query(f"""with {_BASE}, x as (select target, list(u order by source, p) as added from (select target, source, unnest(list_append(aliases, name)) as u, generate_subscripts(list_append(aliases, name), 1) as p from en join mp on source = id) group by 1),
y as (select id, name, list_concat(aliases, coalesce(added, [])) as l from en left join x on target = id where id not in (select source from mp)),
w as (select id, name, u, min(p) as p from (select id, name, unnest(l) as u, generate_subscripts(l, 1) as p from y) where lower(u) <> lower(name) group by all)
select id, name, string_agg(u, '|' order by p) as aliases from w group by all""")
def merged_names(spark, sf):
    merges, entities, _ = base(spark, sf)
    return identity.merged_entities(entities, merges).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""with {_BASE}, re as (select id, a, b, l_returnflag as rel_type, l_returnflag = 'A' as mutual, l_linenumber::int as from_chapter, case when l_quantity > 40 then 9 end as to_chapter, case when l_orderkey % 3 = 0 then l_linestatus end as notes, case when l_orderkey % 5 = 0 then lead(id) over (partition by a, b, l_returnflag order by id) end as successor from ln where a <> b),
mv as (select re.* replace (coalesce(p.target, a) as a, coalesce(q.target, b) as b) from re left join mp p on p.source = a left join mp q on q.source = b),
tc as (select *, successor is null and id not in (select successor from re where successor is not null) and (a in (select target from mp) or b in (select target from mp)) as loose from mv where a <> b)
select * exclude (loose) from tc qualify not loose or row_number() over (partition by loose, case when mutual then least(a, b) else a end, case when mutual then greatest(a, b) else b end, rel_type, mutual, from_chapter, to_chapter, notes order by id) = 1""")
def merged_ties(spark, sf):
    """Relationships after the merge: equal ones of a target collapse unless they supersede or are superseded."""
    from pyspark.sql import Window as W

    merges, _, lines = base(spark, sf)
    rows = lines.where("a <> b").select("id", "a", "b", F.col("l_returnflag").alias("rel_type"), (F.col("l_returnflag") == "A").alias("mutual"), F.col("l_linenumber").cast("int").alias("from_chapter"), F.when(F.col("l_quantity") > 40, 9).alias("to_chapter"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linestatus")).alias("notes"), F.when(F.col("l_orderkey") % 5 == 0, F.lead("id").over(W.partitionBy("a", "b", "l_returnflag").orderBy("id"))).alias("successor"))
    return identity.merged_relationships(files.stored(rows, "ties"), merges)


@query(f"""with {_BASE}, dy as (select min(id) as id, a, b, l_linenumber as chapter from ln where a <> b group by all), md as (select dy.id, coalesce(p.target, a) as a, coalesce(q.target, b) as b, chapter, p.target is not null or q.target is not null as moved from dy left join mp p on p.source = a left join mp q on q.source = b),
ca as (select id, a as subject, l_returnflag || l_linestatus as predicate, l_quantity::varchar as value from ln), mc as (select id, coalesce(target, subject) as subject, predicate, value, target is not null as moved from ca left join mp on source = subject)
select 'dynamic' as tbl, id, a as x, b as y, chapter::varchar as z from md where a <> b qualify row_number() over (partition by a, b, chapter order by moved, id) = 1
union all select 'canon', id, subject, null, predicate from mc qualify row_number() over (partition by subject, predicate order by moved, id) = 1""")
def merged_facts(spark, sf):
    """Dynamics by pair and chapter, and canon by predicate: what the target had wins."""
    merges, _, lines = base(spark, sf)
    dynamics = lines.where("a <> b").groupBy("a", "b", F.col("l_linenumber").alias("chapter")).agg(F.min("id").alias("id"))
    canon = lines.select("id", F.col("a").alias("subject"), F.concat("l_returnflag", "l_linestatus").alias("predicate"), F.col("l_quantity").cast("string").alias("value"))
    one = identity.merged_dynamics(dynamics, merges).select(F.lit("dynamic").alias("tbl"), "id", F.col("a").alias("x"), F.col("b").alias("y"), F.col("chapter").cast("string").alias("z"))
    return one.unionByName(identity.merged_canon(canon, merges).select(F.lit("canon").alias("tbl"), "id", F.col("subject").alias("x"), F.lit(None).cast("long").alias("y"), F.col("predicate").alias("z")))


_HIST = f"""{_BASE}, hv as (select case a % 3 when 0 then 'entities' when 1 then 'locations' else 'scenes' end as tbl, a as row, l_linenumber::int as chapter, min(id) as id, max(b) as parent, list(distinct b order by b) as members, min(l_orderkey % 50)::int as first, count(*) as n from ln group by a, l_linenumber),
hp as (select *, n % 11 = 5 as dead, 'n' || id % 9 as name, ['a' || id % 4] as aliases from hv),
hm as (select h.*, coalesce(t.target, row) as to_row, t.target is null as own from hp h left join mp t on t.source = row where t.target is null or not dead),
hx as (select tbl, row as old, to_row, own, chapter, dead, name, aliases, first, case when tbl = 'entities' then parent else coalesce((select target from mp where source = parent), parent) end as parent,
  case when tbl = 'scenes' then (select list(m order by p) from (select coalesce(target, u) as m, min(p) as p from (select unnest(members) as u, generate_subscripts(members, 1) as p) left join mp on source = u group by 1)) else members end as members from hm),
nm as (select target, list(name order by source) as names from mp join en on id = source group by 1),
hn as (select hx.* exclude (name, aliases), case when nm.target is null then hx.name else en.name end as name, case when nm.target is null then hx.aliases else list_filter(list_concat(hx.aliases, [hx.name], nm.names), lambda x: x <> en.name) end as aliases, nm.target is not null as named from hx left join nm on nm.target = to_row left join en on en.id = to_row),
hk as (select *, count(*) over g as cnt, row_number() over (partition by tbl, to_row, chapter order by own desc, old desc) as k, min(case when not dead then first end) over g as f0 from hn window g as (partition by tbl, to_row, chapter)),
ha as (select tbl, to_row, chapter, string_agg(u, '|' order by o) as al from (select tbl, to_row, chapter, u, min((own, old, p)) as o from (select tbl, to_row, chapter, own, old, unnest(aliases) as u, generate_subscripts(aliases, 1) as p from hn where not dead) group by tbl, to_row, chapter, u) group by all)"""


@query(f"with {_HIST} select tbl, to_row as row, chapter, case when not dead then name end as name, case when not dead then al end as aliases, case when not dead then case when cnt = 1 then first else f0 end end as first, case when not dead then parent end as parent, case when not dead then array_to_string(members, ',') end as members from hk left join ha using (tbl, to_row, chapter) where k = 1")
def merged_history(spark, sf):
    """Versions of three tables with ids inside their payloads, as if the merges had always been so."""
    merges, entities, lines = base(spark, sf)
    rows = lines.groupBy(F.col("a").alias("row"), F.col("l_linenumber").cast("int").alias("chapter")).agg(F.min("id").alias("id"), F.max("b").alias("parent"), F.array_sort(F.collect_set("b")).alias("members"), F.min((F.col("l_orderkey") % 50).cast("int")).alias("first"), F.count("*").alias("n"))
    tbl = F.when(F.col("row") % 3 == 0, "entities").when(F.col("row") % 3 == 1, "locations").otherwise("scenes")
    # the place of a scene is its parent here
    payload = F.struct(F.concat(F.lit("n"), (F.col("id") % 9).cast("string")).alias("name"), F.array(F.concat(F.lit("a"), (F.col("id") % 4).cast("string"))).alias("aliases"), "parent", F.col("parent").alias("place"), "members", "first")
    versions = rows.select(tbl.alias("tbl"), "row", "chapter", F.when(F.col("n") % 11 != 5, payload).alias("payload"))
    out = identity.merged_history(files.stored(versions, "versions"), entities, merges)
    parent = F.when(F.col("tbl") == "scenes", F.col("payload.place")).otherwise(F.col("payload.parent"))
    return out.select("tbl", "row", "chapter", "payload.name", F.array_join("payload.aliases", "|").alias("aliases"), "payload.first", parent.alias("parent"), F.array_join(F.col("payload.members").cast("array<string>"), ",").alias("members"))
