"""Extraction payloads made of the part table, whole and broken, checked against the contracts and composed into records."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loreframe.operators import contracts
from loreframe.plans import bind

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _example(kind: contracts.Kind):
    """A valid value; ``@`` stands for a name."""
    if kind.type == "records":
        return [{n: _example(k) for n, k in kind.fields.items()} | ({"object_name": "@", "change": "gain"} if kind.needs else {})] * 2
    return {"text": "@", "string": "@", "one_of": kind.values[0] if kind.values else "", "whole": 3, "share": 0.5, "flag": True, "names": ["@", "@"]}[kind.type]


#: A valid payload of each pass, in the passes' order.
TEMPLATES = [json.dumps({n: _example(k) for n, k in fields.items()}) for fields in contracts.PASSES.values()]
NAMES = list(contracts.PASSES)
#: (pattern, replacement) of what is broken, by the part's number: nothing, keys, an extra key, types, blanks, values, lists, braces, numbers, nulls.
FAULTS = [("~", "~"), ('"([a-z]+_[a-z]+)": "@"', '"x\\1": "@"'), ("\\}\\]", ', "zz": 1}]'), ('": "@"', '": 5'), ('"@"', '"  "'), ('"(gain|low|open|high|other|action|physical|character|setup|dialogue|foreshadowing)"', '"nonsense"'), ("\\[\\{.*\\}\\]", '"none"'), ("\\}$", ""), ("(3|0\\.5)", "-7"), ('"@"', "null")]


#: Parts of a task: a part is a few bytes of its file, but making and checking its payload takes some 0.2 ms.
TASK_PARTS = 20_000


def payloads(spark, sf):
    """(row_id, chapter, pass, payload): every part is a payload of the pass of its number."""
    parts = bind.table(spark, sf, "part").select("p_partkey", "p_name")
    parts = parts.repartition(parts.count() // TASK_PARTS + 1, "p_partkey")
    key = F.col("p_partkey")
    at = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    fault = F.floor(key / len(NAMES)) % len(FAULTS)
    text = at(TEMPLATES, key % len(NAMES))
    broken = text
    for i, (pattern, new) in enumerate(FAULTS):
        broken = F.when(fault == i, F.regexp_replace(text, pattern, new.replace("\\1", "$1"))).otherwise(broken)
    return parts.select(key.alias("row_id"), F.floor(key / len(NAMES)).alias("chapter"), at(NAMES, key % len(NAMES)).alias("pass"), F.replace(broken, F.lit("@"), F.col("p_name")).alias("payload"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CASES = " ".join(f"when {i} then regexp_replace(t, {_quoted(p)}, {_quoted(n)}, 'g')" for i, (p, n) in enumerate(FAULTS))
_PAYLOADS = f"""pt as (select p_partkey as row_id, p_partkey // {len(NAMES)} as chapter, {NAMES}[p_partkey % {len(NAMES)} + 1] as pass, [{', '.join(map(_quoted, TEMPLATES))}][p_partkey % {len(NAMES)} + 1] as t, p_name from part),
pl as (select row_id, chapter, pass, replace(case chapter % {len(FAULTS)} {_CASES} end, '@', p_name) as payload from pt)"""
_RULES = "ru(pass, list, key, type, nullable, vals, least, required) as (values " + ", ".join(f"({_quoted(p)}, {_quoted(g)}, {_quoted(n)}, {_quoted(t)}, {null}, {values or '[]'}::varchar[], {least if least is not None else 'null'}::int, {req})" for p, g, n, t, null, values, least, req in contracts.rule_rows()) + ")"
_NEEDS = "nd(list, kind, key) as (values " + ", ".join(f"({_quoted(g)}, {_quoted(k)}, {_quoted(n)})" for _, g, _, needs in contracts._groups(contracts.PASSES) for k, own in needs.items() for n in own) + ")"
_BLANK = "coalesce(json_type(m, '$.' || {k}) <> 'VARCHAR' or trim(json_extract_string(m, '$.' || {k})) = '', true)"
_BROKEN = f"""{_PAYLOADS}, {_RULES}, {_NEEDS}, ok as (select row_id, pass, payload::json as m from pl where json_valid(payload)),
lv as (select row_id, pass, key as list, m->key as v from (select *, unnest(json_keys(m)) as key from ok where json_type(m) = 'OBJECT')),
el as (select row_id, pass, list, i, (v->i) as m from (select l.*, unnest(range(json_array_length(v)::int)) as i from lv l join ru r on r.pass = l.pass and r.list = '' and r.key = l.list and r.type = 'records' where json_type(v) = 'ARRAY')),
rc as (select row_id, pass, '' as list, '' as path, m from ok where json_type(m) = 'OBJECT' union all select row_id, pass, list, list || '.' || i, m from el where json_type(m) = 'OBJECT'),
ky as (select *, unnest(json_keys(m)) as key from rc),
vl as (select k.row_id, case when path = '' then '' else path || '.' end || key as path, type, nullable, vals, least, json_type(m, '$.' || key) as t, m->key as v, json_extract_string(m, '$.' || key) as s from ky k join ru using (pass, list, key)),
nm as (select row_id, path || '.' || i as path, v->i as e from (select *, unnest(range(json_array_length(v)::int)) as i from vl where type = 'names' and t = 'ARRAY')),
br as (select row_id, '' as path, 'object' as rule from pl where not json_valid(payload) or json_type(case when json_valid(payload) then payload else '0' end::json) <> 'OBJECT'
union all select row_id, list || '.' || i, 'object' from el where json_type(m) <> 'OBJECT'
union all select row_id, case when path = '' then '' else path || '.' end || r.key, 'missing' from rc join ru r on r.pass = rc.pass and r.list = rc.list where required and not list_contains(json_keys(m), r.key)
union all select k.row_id, case when path = '' then '' else path || '.' end || k.key, 'extra' from ky k anti join ru r on r.pass = k.pass and r.list = k.list and r.key = k.key
union all select distinct row_id, path, 'kind' from rc join nd on nd.list = rc.list and nd.kind = json_extract_string(m, '$.kind') where {_BLANK.format(k="nd.key")}
union all select row_id, path, rule from (select row_id, path, case when t = 'NULL' and nullable then null
  when not case when type in ('text', 'string', 'one_of') then t = 'VARCHAR' when type = 'whole' then t in ('BIGINT', 'UBIGINT') when type = 'share' then t in ('BIGINT', 'UBIGINT', 'DOUBLE') when type = 'flag' then t = 'BOOLEAN' else t = 'ARRAY' end then 'type'
  when type = 'text' and trim(s) = '' then 'blank' when type = 'one_of' and not list_contains(vals, s) then 'enum' when type = 'whole' and s::double < least then 'range' when type = 'share' and s::double not between 0 and 1 then 'range' end as rule from vl) where rule is not null
union all select row_id, path, case when json_type(e) <> 'VARCHAR' then 'type' else 'blank' end from nm where json_type(e) <> 'VARCHAR' or trim(e->>'$') = '')"""


@query(f"with {_BROKEN} select row_id, path, rule from br")
def payload_violations(spark, sf):
    """Every broken rule of the payloads of thirteen passes, by path."""
    return contracts.violations(payloads(spark, sf))


@query(f"with {_BROKEN} select pass, rule, count(*) as n, count(distinct row_id) as n_payloads from br join pl using (row_id) group by all")
def violation_counts(spark, sf):
    rows = payloads(spark, sf)
    broken = contracts.violations(rows).groupBy("row_id", "rule").agg(F.count("*").alias("n"))
    met = broken.join(rows.groupBy("row_id", "pass").agg(F.count("*").alias("_c")), "row_id")
    return met.groupBy("pass", "rule").agg(F.sum(F.col("n") * F.col("_c")).alias("n"), F.count("*").alias("n_payloads"))


_LEN = "coalesce(case when json_valid(p) and json_type(p, '$.{n}') = 'ARRAY' then json_array_length(p, '$.{n}') end, 0)"


@query(f"""with {_PAYLOADS}, g as (select chapter, {', '.join(f"max(case when pass = '{p}' then regexp_extract(payload, '\\{{.*\\}}') end) as {p}" for p in NAMES)} from pl group by 1)
select chapter, coalesce(case when json_valid(chapter_summary) then json_extract_string(chapter_summary, '$.summary') end, '') as summary, coalesce(case when json_valid(multi_granularity_summaries) then json_extract_string(multi_granularity_summaries, '$.summary_long') end, '') as summary_long,
  {', '.join("coalesce(case when json_valid({p}) and json_type({p}, '$.{n}') = 'ARRAY' then json_array_length({p}, '$.{n}') end, 0)::int as n_{n}".format(p=p, n=n) for p, n in (('events', 'events'), ('scene_segmentation', 'scenes'), ('commitments', 'payoffs_delivered'), ('canon_facts', 'canon_facts')))} from g where chapter % {len(FAULTS)} <> 7""")
def composed_records(spark, sf):
    """A chapter's passes as one record; chapters whose braces are broken are left to the contracts."""
    out = contracts.compose(payloads(spark, sf).where(F.col("chapter") % len(FAULTS) != 7), ["chapter"])
    return out.select("chapter", "summary", "summary_long", *[F.size(n).alias(f"n_{n}") for n in ("events", "scenes", "payoffs_delivered", "canon_facts")])
