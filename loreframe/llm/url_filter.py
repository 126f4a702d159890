"""URL filters by rules and by an empirical-Bayes reputation of hosts, in DataFrame operations only.

A page's outcome is bad or good where it is labelled. Bad outcomes of a host are shrunk towards those
of its registered domain, these towards its suffix, and these towards all pages: at each level the
children's counts are beta-binomial, and the prior's strength is found by the method of moments over
all children; a prior is never worth more than ``MOST`` outcomes, so that it can't swallow what a host itself shows
where most hosts are alike. A page is blocked where the lower bound of its host's posterior, ``Z`` deviations below the
mean, exceeds ``MULTIPLE`` times the share of bad outcomes among all: where the host is worse than the corpus.

Hosts with many pages are dealt over several tasks when their reputation meets the pages.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the
reputation of the empty host. Hosts without labels take their parents' posterior. Equal rows give
equal results. Empty tables give an empty result. Extra columns of pages are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreframe.llm.shared import LOWER, UPPER, hot_join, hot_keys, stored

#: Rule = (host, path prefix, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Suffixes of two labels under which domains are registered; fixed values.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.in", "com.br", "com.cn", "com.mx", "co.za", "co.kr")
MULTIPLE, Z, MOST = 1.0, 1.0, 10


def with_host(pages: DataFrame) -> DataFrame:
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(raw, UPPER, LOWER), "path": path})


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Rules are looked up by each suffix of the host."""
    by_host: dict[str, list] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(p).alias("start"), F.lit(verdict).alias("verdict")))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())), lambda r: F.startswith(path, r["start"]))
    best = F.array_max(found)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def levels(host: Column) -> dict[str, Column]:
    """The registered domain and the suffix of a host."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    width = F.when(two.isin(*SUFFIXES), 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    return {"domain": last(width + 1), "suffix": last(width)}


def _strength(children: DataFrame) -> DataFrame:
    """One row: the prior's strength kappa by moments of (bad, n) around each child's own prior mean m.

    Var(bad) = n m (1 - m) (1 + (n - 1) rho) with rho = 1 / (kappa + 1); rho is solved from sums over all
    children with at least two outcomes and kept within [1 / (MOST + 1), 0.999].
    """
    spread = F.col("m") * (1 - F.col("m"))
    over = F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2 - F.col("n") * spread)
    room = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    rho = F.greatest(F.lit(1 / (MOST + 1)), F.least(F.lit(0.999), F.coalesce(F.when(F.col("room") > 0, F.col("over") / F.col("room")), F.lit(0.5))))
    return children.where("n >= 2").agg(over.alias("over"), room.alias("room")).select(F.round(1 / rho - 1, 6).alias("kappa"))


def reputation(pages: DataFrame, outcomes: DataFrame, limit: float | None = None, z: float = Z, multiple: float = MULTIPLE) -> DataFrame:
    """One row a host: host, pages, n, bad, mean, bound and blocked, from outcomes (page_id, bad). ``limit`` takes the place of the multiple.

    Counts are grouped by host before anything else meets, so a host with a third of all rows costs one
    row a task. The top level is one row, the suffix, domain and host levels are joined on their keys.
    """
    counted = pages.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id", "left")
    hosts = counted.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stored(hosts.withColumns(levels(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("m"))

    def shrunk(children: DataFrame) -> DataFrame:
        kappa = _strength(children)
        mean = (F.col("bad") + F.col("kappa") * F.col("m")) / (F.col("n") + F.col("kappa"))
        return children.crossJoin(F.broadcast(kappa)).withColumn("mean", F.round(mean, 9))

    suffixes = stored(shrunk(suffixes.crossJoin(F.broadcast(top))).select("suffix", F.col("mean").alias("m")), "suffixes")
    domains = stored(shrunk(domains.join(suffixes, "suffix")).select("domain", "suffix", F.col("mean").alias("m")), "domains")
    hosts = shrunk(hosts.join(domains, ["domain", "suffix"])).crossJoin(F.broadcast(top.select((F.round(F.col("m") * multiple, 9) if limit is None else F.lit(limit)).alias("limit"))))
    bound = F.round(F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("kappa") + 1)), 9)
    return hosts.withColumn("bound", bound).select("host", "pages", "n", "bad", "mean", "bound", (F.col("bound") > F.col("limit")).alias("blocked"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float | None = None, z: float = Z, multiple: float = MULTIPLE) -> DataFrame:
    """pages with host, path, rule, verdict and bound: the rule's verdict, else the reputation's."""
    known = with_host(pages)
    hosts = stored(reputation(known, outcomes, limit, z, multiple), "reputation")
    facts = hosts.select("host", F.col("bound").alias("_bound"), F.col("blocked").alias("_blocked"))
    judged = hot_join(known.withColumn("_fit", rule_for(F.col("host"), F.col("path"), rules)), facts, "host", hot_keys(hosts, "host", "pages"), "page_id")
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("_blocked"), "block").otherwise("allow"))
    return judged.withColumns({"rule": F.col("_fit.rule"), "verdict": verdict, "bound": F.col("_bound")}).select(*[c for c in known.columns if c not in ("rule", "verdict", "bound")], "rule", "verdict", "bound")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Outcomes of pages from labels by id: bad is 1 where toxic is 1 or quality is 0; rows without either are left out."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))


ORACLE = """
with x as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
y as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from x),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from y),
rules(h, start, v) as (values ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
fits as (select host, path, arg_max(h || start, length(h || start)) as rule, arg_max(v, length(h || start)) as v
        from (select distinct host, path from p) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, start) group by all),
o as (select doc_id as page_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels
        where doc_id is not null and (toxic is not null or quality is not null) group by doc_id),
h0 as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad from p left join o using (page_id) group by host),
h1 as (select *, string_split(host, '.') as l from h0),
h2 as (select host, n, bad, l, case when list_contains(['co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.jp','ne.jp','or.jp','co.nz','co.in','com.br','com.cn','com.mx','co.za','co.kr'],
        array_to_string(l[greatest(len(l) - 1, 1):], '.')) then 2 else 1 end as w from h1),
h as (select host, n, bad, array_to_string(l[greatest(len(l) - w, 1):], '.') as domain, array_to_string(l[greatest(len(l) - w + 1, 1):], '.') as suffix from h2),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by all),
s1 as (select s.*, (select (coalesce(sum(bad), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1.0::double) from s) as m from s),
sk as (select round(1 / greatest(1::double / 11, least(0.999::double, coalesce(case when sum(n * (n - 1) * m * (1 - m)) filter (n >= 2) > 0 then sum((bad - n * m) ** 2 - n * m * (1 - m)) filter (n >= 2) / sum(n * (n - 1) * m * (1 - m)) filter (n >= 2) end, 0.5::double))) - 1, 6) as k from s1),
s2 as (select suffix, round((bad + k * m) / (n + k), 9) as m from s1, sk),
d1 as (select d.*, m from d join s2 using (suffix)),
dk as (select round(1 / greatest(1::double / 11, least(0.999::double, coalesce(case when sum(n * (n - 1) * m * (1 - m)) filter (n >= 2) > 0 then sum((bad - n * m) ** 2 - n * m * (1 - m)) filter (n >= 2) / sum(n * (n - 1) * m * (1 - m)) filter (n >= 2) end, 0.5::double))) - 1, 6) as k from d1),
d2 as (select domain, suffix, round((bad + k * m) / (n + k), 9) as m from d1, dk),
h3 as (select h.*, m from h join d2 using (domain, suffix)),
hk as (select round(1 / greatest(1::double / 11, least(0.999::double, coalesce(case when sum(n * (n - 1) * m * (1 - m)) filter (n >= 2) > 0 then sum((bad - n * m) ** 2 - n * m * (1 - m)) filter (n >= 2) / sum(n * (n - 1) * m * (1 - m)) filter (n >= 2) end, 0.5::double))) - 1, 6) as k from h3),
h4 as (select host, n, k, round((bad + k * m) / (n + k), 9) as mean from h3, hk),
r as (select host, round(mean - sqrt(mean * (1 - mean) / (n + k + 1)), 9) > (select round(any_value(m), 9) from s1) as blocked from h4)
select p.page_id, p.host, p.path, f.rule, coalesce(f.v, case when r.blocked then 'block' else 'allow' end) as verdict
from p left join fits f on p.host = f.host and p.path = f.path left join r on p.host = r.host
"""
