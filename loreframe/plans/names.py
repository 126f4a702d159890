"""Queries over names: surfaces, duplicates, resolution, gates, renames and rosters (part, supplier, customer, nation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreframe.functions import text as X
from loreframe.operators import entity, ingest, metrics
from loreframe.plans import bind

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def parts(spark, sf):
    """part as entities of eight novels: name and type vary by key, aliases are brand and name."""
    p = bind.table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "character").when(F.col("p_size") % 3 == 1, "location").otherwise("object")
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, "The ").otherwise(""), F.initcap("p_name"), F.lit(" "), (F.col("p_partkey") % 200).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "!").otherwise(""))
    aliases = F.when(F.col("p_partkey") % 6 == 0, F.array(F.concat("p_brand", F.lit(" "), (F.col("p_partkey") % 50).cast("string")))).otherwise(F.array().cast("array<string>"))
    return p.select((F.col("p_partkey") % 8).alias("novel"), F.col("p_partkey").alias("id"), kind.alias("entity_type"), name.alias("name"), aliases.alias("aliases"))


_PARTS = """pt as (select p_partkey % 8 as novel, p_partkey as id, case p_size % 3 when 0 then 'character' when 1 then 'location' else 'object' end as entity_type,
    case when p_partkey % 4 = 0 then 'The ' else '' end || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_partkey % 200 || case when p_partkey % 5 = 0 then '!' else '' end as name,
    case when p_partkey % 6 = 0 then [p_brand || ' ' || p_partkey % 50] else [] end as aliases from part),
su0 as (select novel, id, entity_type, unnest(list_append(aliases, name)) as s, name from pt),
su as (select novel, id, entity_type, regexp_replace(regexp_replace(lower(s), '^(the |an |a )', ''), '[.,;:!?]+$', '') as surface, bool_or(s = name) as is_name from su0 group by all)"""


def names(spark, sf):
    return entity.surfaces(parts(spark, sf), ["novel"])


@query(f"with {_PARTS} select * from su")
def surfaces(spark, sf):
    return names(spark, sf)


@query("")
def duplicate_pairs(spark, sf):
    """Pairs of surfaces by the entities that represent them, and which others share a surface: copies aren't expanded into all pairs."""
    return entity.duplicate_classes(names(spark, sf), ["novel"]).withColumn("score", F.round("score", 9))


@query(f"with {_PARTS}, o as (select novel, surface, min(id) as id from su group by all having count(distinct id) = 1), c as (select p_partkey as ref_id, p_partkey % 8 as novel, regexp_replace(lower(p_name), '^(the |an |a )', '') || ' ' || p_partkey % 250 as s from part) select c.novel, ref_id, id from c join o on c.novel = o.novel and s = surface")
def exact_matches(spark, sf):
    refs = bind.table(spark, sf, "part").select((F.col("p_partkey") % 8).alias("novel"), F.col("p_partkey").alias("ref_id"), F.concat(F.upper("p_name"), F.lit(" "), (F.col("p_partkey") % 250).cast("string"), F.lit(".")).alias("name"))
    return entity.match_exact(refs, names(spark, sf), ["novel"]).select("novel", "ref_id", "id")


@query("")
def unambiguous_matches(spark, sf):
    refs = bind.table(spark, sf, "part").select((F.col("p_partkey") % 8).alias("novel"), F.concat("p_name", F.lit("s "), (F.col("p_partkey") % 250).cast("string")).alias("name"))
    return entity.match_unambiguous(refs, names(spark, sf), ["novel"])


@query(f"with {_PARTS}, c as (select l_orderkey as ref_id, l_linenumber as line, l_partkey % 8 as novel, p_name || ' ' || l_partkey % 300 as s from lineitem join part on l_partkey = p_partkey), o as (select novel, surface, arg_min(id, (not is_name, case entity_type when 'character' then 1 when 'location' then 2 else 3 end, id)) as id from su group by all) select ref_id, line, c.novel, id from c left join o on c.novel = o.novel and lower(trim(s)) = surface")
def resolved_names(spark, sf):
    p = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    refs = bind.table(spark, sf, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("ref_id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 8).alias("novel"), F.concat("p_name", F.lit(" "), (F.col("l_partkey") % 300).cast("string")).alias("name"))
    return entity.resolve_names(refs, names(spark, sf), ["novel"], ["character", "location", "object"]).select("ref_id", "line", "novel", "id")


@query(f"with {_PARTS}, c as (select p_partkey as ref_id, p_partkey % 8 as novel, case when p_partkey % 2 = 0 then p_name else p_name || ' ' || p_partkey % 200 || ' extra' end as r from part), m as (select c.novel, ref_id, id from c join su on c.novel = su.novel and (r = surface or starts_with(surface, r || ' ') or starts_with(r, surface || ' '))) select novel, ref_id, min(id) as id from m group by all having count(distinct id) = 1")
def partial_matches(spark, sf):
    full = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 200).cast("string"), F.lit(" extra"))
    refs = bind.table(spark, sf, "part").select((F.col("p_partkey") % 8).alias("novel"), F.col("p_partkey").alias("ref_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(full).alias("name"))
    return entity.resolve_partial(refs, names(spark, sf), ["novel"])


@query("""with n as (select p_partkey as ref, case when p_partkey % 3 = 0 then 'character' else 'object' end as t, p_partkey % 4 <> 0 as v, p_partkey % 5 <> 0 as k, case when p_partkey % 6 = 0 then p_name else 'nothing of the kind' end as a, p_name || ' in the hall' as x from part)
select ref, case when not v or not k then 'reject' when contains(x, a) then 'alias' when t = 'character' then 'reject' when ref % 2 = 1 then 'alias' else 'chapter' end as tier from n""")
def gated_nominations(spark, sf):
    p, key = bind.table(spark, sf, "part"), F.col("p_partkey")
    rows = p.select(F.lit(0).alias("novel"), key.cast("string").alias("surface"), key.alias("id"), F.when(key % 3 == 0, "character").otherwise("object").alias("entity_type"), (key % 4 != 0).alias("verdict"), (key % 5 != 0).alias("known"), F.when(key % 6 == 0, F.col("p_name")).otherwise("nothing of the kind").alias("anchor"), F.concat("p_name", F.lit(" in the hall")).alias("text"))
    close = p.where("p_partkey % 2 = 1").select(F.lit(0).alias("novel"), key.cast("string").alias("surface"), key.alias("id"))
    return entity.gate_nominations(rows, close, ["novel"]).select(F.col("id").alias("ref"), "tier")


@query("""with m as (select s_suppkey // 3 as g, s_name as member, case when s_suppkey % 9 in (0, 4) then s_suppkey // 2 end as id from supplier union all select s_suppkey // 3 + 1, s_name, case when s_suppkey % 9 in (0, 4) then s_suppkey // 2 end from supplier where s_suppkey % 30 = 0),
o as (select member, count(distinct g) as n from m group by 1), f as (select g, max(o.n) as n, count(distinct id) as ids, count(*) as c, arg_min(member, member) filter (id is not null) as known, min(member) as first from m join o using (member) group by 1)
select g as group_id, member, coalesce(known, first) as canonical from m join f using (g) where f.n = 1 and ids <= 1 and c >= 2""")
def gated_groups(spark, sf):
    s, key = bind.table(spark, sf, "supplier"), F.col("s_suppkey")
    each = s.select(F.floor(key / 3).alias("group_id"), F.col("s_name").alias("m")).unionByName(s.where("s_suppkey % 30 = 0").select((F.floor(key / 3) + 1).alias("group_id"), F.col("s_name").alias("m")))
    groups = each.groupBy("group_id").agg(F.collect_set("m").alias("members")).select(F.lit(0).alias("novel"), "group_id", F.lit("nobody").alias("nominated"), F.array_append("members", F.lit("hallucinated")).alias("members"))
    known = s.select(F.lit(0).alias("novel"), F.col("s_name").alias("name"), F.when(key.isNotNull() & (key % 9).isin(0, 4), F.floor(key / 2)).alias("id"))
    return entity.gate_groups(groups, known, ["novel"]).select("group_id", "member", "canonical")


@query("")
def roster_subset(spark, sf):
    rows = bind.table(spark, sf, "part")
    wanted = rows.select((F.col("p_partkey") % 8).alias("novel"), F.col("p_name").alias("surface"))
    roster = rows.select((F.col("p_partkey") % 8).alias("novel"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), F.col("p_name").alias("surface"))
    return entity.roster_subset(wanted, roster, ["novel"], 5)


@query("")
def suggested_names(spark, sf):
    wrong = bind.table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.lit(0).alias("novel"), F.col("p_partkey").alias("query_id"), F.regexp_replace("p_name", "e", "a").alias("surface"))
    known = bind.table(spark, sf, "part").select(F.lit(0).alias("novel"), F.col("p_name").alias("surface")).distinct()
    return entity.suggest_names(wrong, known, ["novel"])


@query("""with t as (select p_partkey % 8 as novel, p_name as name, p_size % 2 as owner, p_type, min(p_partkey) as k from part group by all), u as (select novel, name, owner, string_agg(p_type, '|' order by k) as types from t group by all),
b as (select p_partkey % 8 as novel, p_name as name, p_size % 2 as owner, arg_min(p_brand, p_partkey) filter (p_partkey % 3 <> 0) as brand from part group by all) select novel, name, owner, brand, types from u join b using (novel, name, owner)""")
def merged_entities(spark, sf):
    """Records of one name: the first brand that isn't empty, and all types in order."""
    rows = bind.table(spark, sf, "part").select((F.col("p_partkey") % 8).alias("novel"), F.col("p_name").alias("name"), (F.col("p_size") % 2).alias("owner"), "p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("").alias("brand"), F.array("p_type").alias("types"))
    out = ingest.merge_entities(rows, ["novel", "name", "owner"], "p_partkey", ["brand"], ["types"])
    return out.withColumn("types", F.array_join("types", "|"))


@query("select distinct p_partkey % 8 as novel, 'object' as entity_type, p_name as name from part union select distinct p_partkey % 8, 'faction', p_brand from part union select distinct p_partkey % 8, 'location', unnest([p_type, p_type || ' hall']) from part")
def referenced_names(spark, sf):
    rows = bind.table(spark, sf, "part").select((F.col("p_partkey") % 8).alias("novel"), "p_name", "p_brand", F.array("p_type", F.concat("p_type", F.lit(" hall"))).alias("places"))
    return ingest.referenced_names(rows, {"p_name": "object", "p_brand": "faction", "places": "location"}, ["novel"])


@query("with r as (select distinct p_partkey % 8 as novel, p_name as name, 'renamed ' || p_name as new_name from part where starts_with(p_name, 's')) select p_partkey as id, coalesce(r.new_name, p_name) as name from part left join r on r.novel = p_partkey % 8 and lower(r.name) = lower(p_name)")
def renamed(spark, sf):
    rows = bind.table(spark, sf, "part").select((F.col("p_partkey") % 8).alias("novel"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    renames = rows.where(F.startswith("name", F.lit("s"))).select("novel", F.upper("name").alias("name"), F.concat(F.lit("renamed "), "name").alias("new_name")).distinct()
    return ingest.apply_renames(rows, renames, ["name"], ["novel"]).select("id", "name")


@query("with a as (select p_partkey % 8 as novel, p_name as name, min(p_partkey) as id from part where p_size > 25 group by all) select p_partkey as ref_id, a.id from part left join a on a.novel = p_partkey % 8 and a.name = p_name")
def resolved_references(spark, sf):
    rows = bind.table(spark, sf, "part").select((F.col("p_partkey") % 8).alias("novel"), F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("name"), "p_size")
    known, unknown = ingest.resolve_references(rows.select("novel", "ref_id", "name"), rows.where("p_size > 25").select("novel", "name", F.col("ref_id").alias("id")), ["novel"])
    return known.select("ref_id", "id").unionByName(unknown.select("ref_id", F.lit(None).cast("long").alias("id")))


@query("select r_regionkey as id, r_name as name, coalesce(string_agg(n_name, ',' order by n_name), '') as aliases from region left join nation on n_regionkey = r_regionkey and n_nationkey % 2 = 0 group by all")
def folded_parents(spark, sf):
    children = bind.table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"))
    parents = bind.table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return ingest.fold_parents(children, parents).withColumn("aliases", F.array_join("aliases", ","))


@query("with p as (select s_suppkey as id, case when s_suppkey % 3 = 0 then 'Supplier#' || lpad((s_suppkey + 1)::varchar, 9, '0') else 'nick ' || s_suppkey % 40 end as alias from supplier), f as (select p.* from p where not exists (select 1 from supplier o where lower(o.s_name) = lower(p.alias) and o.s_suppkey <> p.id)), g as (select * from f qualify id = min(id) over (partition by lower(alias))) select s_suppkey as id, coalesce(string_agg(alias, ',' order by alias), '') as aliases from supplier left join g on g.id = s_suppkey group by 1")
def merged_aliases(spark, sf):
    s, key = bind.table(spark, sf, "supplier"), F.col("s_suppkey")
    alias = F.when(key % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((key + 1).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("nick "), (key % 40).cast("string")))
    entities = s.select(key.alias("id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return ingest.merge_aliases(s.select(key.alias("id"), alias.alias("alias")), entities).withColumn("aliases", F.array_join("aliases", ","))


@query("select p_partkey as id, case lower(trim(p_type)) when 'economy' then 'Economy' when 'small' then 'Small' end as entity_type from part where lower(trim(p_type)) in ('economy', 'small')")
def registered_custom(spark, sf):
    registry = spark.createDataFrame([("Economy",), ("Small",)], "type_name string")
    custom = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.lower("p_type")).alias("entity_type"))
    return ingest.registered_types(custom, registry)[0].select("id", "entity_type")


@query("""with e as (select distinct l_suppkey % 12 as novel, l_partkey as id from lineitem), r as (select p_partkey % 12 as novel, p_partkey as id, p_size as recency from part),
x as (select r.*, e.id is not null as m from r left join e using (novel, id)) select novel, id, row_number() over (partition by novel order by (not m)::int, case when m then id end, recency desc, id)::int as position from x qualify position <= 40""")
def selected_context(spark, sf):
    """The roster of each novel: what its draft mentions, then the rest by recency."""
    mentions = bind.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 12).alias("novel"), F.col("l_partkey").alias("id"))
    key = F.col("p_partkey")
    roster = bind.table(spark, sf, "part").select((key % 12).alias("novel"), key.alias("id"), key.alias("place"), F.col("p_size").alias("recency"))
    return ingest.select_context(mentions, roster, ["novel"], 40)


@query("with x as (select p_name as surface, case p_size % 3 when 0 then 'character' when 1 then 'location' else 'object' end as t, p_partkey as id from part), c as (select surface, arg_min(t, id) as actual from x group by 1), e as (select distinct p_name as surface, 'object' as expected from part) select count(*) as found, count_if(expected = actual) as right, round(count_if(expected = actual) / count(*), 9) as accuracy from e join c using (surface)")
def type_accuracy(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, "character").when(F.col("p_size") % 3 == 1, "location").otherwise("object")
    rows = bind.table(spark, sf, "part").select(F.col("p_name").alias("surface"), kind.alias("entity_type"), F.col("p_partkey").alias("id"))
    return metrics.type_accuracy(rows.select("surface", F.lit("object").alias("expected_type")).distinct(), rows)[0]


@query("")
def entity_scores(spark, sf):
    rows = bind.table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("document"), F.col("p_name").alias("name"), "p_size")
    return metrics.score_entities(rows.where("p_size < 30"), rows.where("p_size > 10").withColumn("name", F.when(F.col("p_size") % 4 == 0, F.substring_index("name", " ", 1)).otherwise(F.col("name"))), "document")


@query("""with x as (select s_suppkey as id, unnest(['a', s_name, 'b', 'a', 'n' || s_nationkey, 'b']) as x, unnest(range(6)) as i, s_name from supplier), f as (select id, x, min(i) as i from x where x <> s_name group by all), j as (select id, string_agg(x, ',' order by i) as aliases from f group by 1)
select id, aliases, case s_nationkey % 3 when 0 then 1.0 when 1 then 0.6 end::double as level from j join supplier on s_suppkey = id""")
def aliases_and_levels(spark, sf):
    """Aliases of two entities in order, distinct, without the own name; levels as numbers."""
    rows = bind.table(spark, sf, "supplier")
    union = X.union_aliases(F.col("s_name"), F.array(F.lit("a"), "s_name", F.lit("b")), F.array(F.lit("a"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("b")))
    level = F.when(F.col("s_nationkey") % 3 == 0, "High").when(F.col("s_nationkey") % 3 == 1, " medium").otherwise("none")
    return rows.select(F.col("s_suppkey").alias("id"), F.array_join(union, ",").alias("aliases"), X.level(level).alias("level"))


#: Suppliers within suppliers: chains of six; every fifth chain closes into a cycle.
@query("""with recursive pl as (select s_suppkey as id, s_name as name, case when s_suppkey % 3 = 0 then ['old ' || s_name] else [] end as aliases, case when s_suppkey % 6 <> 0 then s_suppkey - 1 when s_suppkey % 30 = 0 then s_suppkey + 5 when s_suppkey % 12 = 0 then 1000000 end as parent from supplier),
e as (select id, parent from pl where parent in (select id from pl)), r as (select id, parent as up from e union select r.id, e.parent from r join e on e.id = r.up),
t as (select id, coalesce(min(up) filter (up not in (select id from e)), min(up) filter (up in (select id from r where up = id))) as root from r group by 1), g as (select id, root from t where id <> root),
a as (select root as id, unnest(list_append(aliases, name)) as alias from g join pl using (id) union select id, unnest(aliases) from pl)
select p.id, p.name, coalesce(string_agg(distinct a.alias, ',' order by a.alias) filter (a.alias <> p.name), '') as aliases from pl p left join a on a.id = p.id where p.id not in (select id from g) group by p.id, p.name""")
def folded_chains(spark, sf):
    """Places within places, however deep: the outermost one stays and knows the names of all below it."""
    key = F.col("s_suppkey")
    parent = F.when(key % 6 != 0, key - 1).when(key % 30 == 0, key + 5).when(key % 12 == 0, F.lit(1_000_000))
    places = bind.table(spark, sf, "supplier").select(key.alias("id"), F.col("s_name").alias("name"), F.when(key % 3 == 0, F.array(F.concat(F.lit("old "), "s_name"))).alias("aliases"), parent.cast("long").alias("parent_id"))
    return ingest.fold_chains(places)[0].withColumn("aliases", F.array_join("aliases", ","))


_COV = """ex as (select p_partkey % 100 as document, p_partkey as e, p_name as n, p_brand as alias from part where p_size % 2 = 0),
ac as (select p_partkey % 100 as document, p_partkey as a, case p_partkey % 5 when 0 then string_split(p_name, ' ')[1] when 1 then 'the ' || p_name || ' here' when 2 then lower(p_brand) when 3 then 'x' || p_name else p_name end as n from part where p_size % 3 <> 0),
ef as (select document, e, trim(regexp_replace(lower(n), '\\s+', ' ', 'g')) as n, lower(alias) as alias from ex), af as (select document, a, trim(regexp_replace(lower(n), '\\s+', ' ', 'g')) as n from ac),
al as (select distinct document, n, alias from ef), xa as (select distinct document, a, e from af join (select document, e, n from ef union select ef.document, e, al.alias from ef join al using (document, n)) using (document, n)),
pa as (select document, a, e from af join ef using (document) where (document, a) not in (select document, a from xa) and (contains(' ' || ef.n || ' ', ' ' || af.n || ' ') or contains(' ' || af.n || ' ', ' ' || ef.n || ' '))),
eg as (select document, a, count(*) as c, min(e) as e from (select * from xa union all select * from pa) group by all)"""


@query(f"""with {_COV}, m as (select document, count(distinct e) as matched from eg where c = 1 group by 1), w as (select document, count(*) as expected from ef group by 1), h as (select document, count(*) as actual from af group by 1),
ms as (select document, string_agg(n, '|' order by n) as missing from ef where (document, e) not in (select document, e from eg where c = 1) group by 1), am as (select document, string_agg(n, '|' order by n) as ambiguous from af where (document, a) in (select document, a from eg where c > 1) group by 1)
select document, coalesce(expected, 0) as expected, coalesce(actual, 0) as actual, coalesce(matched, 0) as matched, round(case when actual > 0 then coalesce(matched, 0) / actual else 1 end, 9) as precision, round(case when expected > 0 then coalesce(matched, 0) / expected else 1 end, 9) as recall,
  coalesce(missing, '') as missing, coalesce(ambiguous, '') as ambiguous from w full join h using (document) left join m using (document) left join ms using (document) left join am using (document)""")
def entity_coverage(spark, sf):
    """Names found against names expected, with aliases; ambiguous ones get no credit."""
    from loreframe.operators import metrics

    rows = bind.table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("document"), F.col("p_name").alias("name"), "p_partkey", "p_size", "p_brand")
    key = F.col("p_partkey") % 5
    said = F.when(key == 0, F.substring_index("name", " ", 1)).when(key == 1, F.concat(F.lit("the "), "name", F.lit(" here"))).when(key == 2, F.lower("p_brand")).when(key == 3, F.concat(F.lit("x"), "name")).otherwise(F.col("name"))
    want = rows.where("p_size % 2 = 0")
    out = metrics.entity_coverage(want, rows.where("p_size % 3 <> 0").withColumn("name", said), want.select("document", "name", F.col("p_brand").alias("alias")), "document")
    return out.drop("extra").withColumns({"missing": F.array_join("missing", "|"), "ambiguous": F.array_join("ambiguous", "|")})
