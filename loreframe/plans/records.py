"""Queries over record versions, threads, commitments, flags, drafts and customers (orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreframe.operators import asof, checks, folds, ingest, reads
from loreframe.plans import bind
from loreframe.plans.bind import VERSIONS

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


YEARS = (1996, 1998, 2000)
CUTS = "k(cutoff) as (values (1996), (1998), (2000))"


def cutoffs(spark):
    return spark.createDataFrame([(y,) for y in YEARS], "cutoff int")


def payload(rows):
    return rows.withColumns({"status": F.col("payload.status"), "price": F.col("payload.price")}).drop("payload")


@query(f"with {VERSIONS}, {CUTS} select novel, row, cutoff, arg_max(status, chapter) filter (true) as status, arg_max(price, chapter) as price from (select v.*, cutoff, row_number() over (partition by row, cutoff order by chapter desc) as i from v, k where chapter <= cutoff) where i = 1 and status is not null group by all")
def records_at_cutoffs(spark, sf):
    return payload(asof.records_at(bind.versions(spark, sf), cutoffs(spark), ["novel", "row"]))


_STATE = "o(novel, row, status, price) as (select novel, row, status, price from (select *, row_number() over (partition by row order by chapter desc) as i from v where chapter <= {y}) where i = 1 and status is not null)"


@query(f"with {VERSIONS}, a as (with {_STATE.format(y=1999)} select * from o), b as (with {_STATE.format(y=1998)} select * from o) select coalesce(a.novel, b.novel) as novel, coalesce(a.row, b.row) as row, 1999 as chapter, a.status, a.price from a full join b on a.row = b.row where a.status is distinct from b.status or a.price is distinct from b.price")
def captured_versions(spark, sf):
    versions = bind.versions(spark, sf)
    at = lambda y: asof.records_at(versions, spark.createDataFrame([(y,)], "cutoff int"), ["novel", "row"])
    return payload(asof.capture_versions(at(1999), at(1998), ["novel", "row"], F.lit(1999)))


@query(f"with {VERSIONS} select novel, row, chapter, status, price from v window w as (partition by novel, row order by chapter) qualify status is distinct from lag(status) over w or price is distinct from lag(price) over w")
def version_log(spark, sf):
    return payload(asof.version_log(bind.versions(spark, sf), ["novel", "row"]))


@query(f"with {VERSIONS} select novel, row, chapter, status, price from v where chapter <= 1998 and novel not in (4, 9)")
def restored_prefix(spark, sf):
    baselines = spark.createDataFrame([(n, 2000 if n in (4, 9) else 1996) for n in range(10)], "novel long, baseline int")
    return payload(asof.restore_prefix(bind.versions(spark, sf), 1998, baselines, ["row"])[0])


@query(f"""with {VERSIONS}, cur as (select novel, row, arg_max(coalesce(status, '-'), chapter) as status, arg_max(coalesce(price, -1), chapter) as price from v group by all),
x as (select v.*, row_number() over (partition by row order by chapter desc) as i from v where chapter <= 1998 and novel between 2 and 7)
select novel, row, 1998 as cutoff, status, price from cur where novel < 2 and status <> '-' union all select novel, row, 1998, status, price from x where i = 1 and status is not null""")
def records_with_history(spark, sf):
    """Novels 0 and 1 have no history yet; 2 to 7 have one from 1996, 8 and 9 from 2000."""
    versions = bind.versions(spark, sf)
    current = versions.groupBy("novel", "row").agg(F.max_by("payload", "chapter").alias("payload")).where("payload is not null")
    baselines = spark.createDataFrame([(n, 1996 if n < 8 else 2000) for n in range(2, 10)], "novel long, baseline int")
    asked = spark.createDataFrame([(n, 1998) for n in range(10)], "novel long, cutoff int")
    return payload(asof.with_history(current, versions, asked, baselines, ["novel", "row"]))


def threads(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("stalled")
    return bind.table(spark, sf, "orders").select(F.col("o_custkey").alias("thread"), F.year("o_orderdate").alias("chapter"), F.col("o_orderkey").alias("ordinal"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("description"))


_THREADS = """t0 as (select o_custkey as thread, year(o_orderdate)::int as chapter, o_orderkey as ordinal, case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'progressing' end as status,
    case when o_orderkey % 3 = 0 then o_orderpriority end as description from orders),
t as (select thread, arg_max(status, (chapter, ordinal)) as status, arg_max(description, (chapter, ordinal)) filter (description is not null) as description, min(chapter) as opened, max(chapter) as last from t0 group by 1),
th as (select thread, status, description, opened, case when status = 'closed' then last end as closed from t)"""


@query(f"with {_THREADS} select * from th")
def folded_threads(spark, sf):
    return folds.fold_threads(threads(spark, sf), ["thread"])


@query(f"""with {_THREADS}, {CUTS}, x as (select thread, cutoff, opened, closed, status, cutoff >= 2001 as uncapped from th, k where opened <= cutoff)
select thread, cutoff, opened, case when closed <= cutoff then closed end as closed, case when status = 'closed' and closed <= cutoff then 'closed' when status = 'closed' then 'progressing' else status end as status from x""")
def threads_at_cutoffs(spark, sf):
    rows = folded_threads(spark, sf).crossJoin(F.broadcast(cutoffs(spark))).where("opened <= cutoff")
    status = reads.thread_status_at(F.col("status"), F.col("closed"), F.col("cutoff"), F.col("cutoff") >= 2001)
    return rows.select("thread", "cutoff", "opened", asof.masked("closed", "cutoff").alias("closed"), status.alias("status"))


@query(f"with {_THREADS}, {CUTS} select cutoff, count(*) as open_threads from th, k where opened <= cutoff and not (status = 'closed' and closed <= cutoff) group by 1")
def open_threads(spark, sf):
    return threads_at_cutoffs(spark, sf).where("status <> 'closed'").groupBy("cutoff").agg(F.count("*").alias("open_threads"))


def commitments(spark, sf):
    year = F.year("o_orderdate")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "broken").when(F.col("o_orderstatus") == "F", "satisfied").otherwise("pending")
    return bind.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("novel"), F.col("o_orderkey").alias("id"), year.alias("foreshadow_chapter"), status.alias("status"), F.when(F.col("o_orderstatus") == "F", year + (F.col("o_orderkey") % 3).cast("int")).alias("payoff_chapter"))


_COMMIT = "cm as (select o_custkey % 10 as novel, o_orderkey as id, year(o_orderdate)::int as foreshadow_chapter, case when o_orderpriority = '1-URGENT' then 'broken' when o_orderstatus = 'F' then 'satisfied' else 'pending' end as status, case when o_orderstatus = 'F' then (year(o_orderdate) + o_orderkey % 3)::int end as payoff_chapter from orders)"


@query(f"with {_COMMIT}, k(cutoff) as (values (1996), (1998), (2005)) select id, cutoff, case when status = 'broken' and cutoff >= 2003 then status when payoff_chapter <= cutoff then 'satisfied' else 'pending' end as status, case when payoff_chapter <= cutoff then payoff_chapter end as payoff_chapter, cutoff - foreshadow_chapter as age_chapters from cm, k where foreshadow_chapter <= cutoff")
def commitments_at_cutoffs(spark, sf):
    rows = commitments(spark, sf).crossJoin(F.broadcast(spark.createDataFrame([(1996,), (1998,), (2005,)], "cutoff int"))).where("foreshadow_chapter <= cutoff")
    status = reads.commitment_status_at(F.col("status"), F.col("payoff_chapter"), F.col("cutoff"), F.col("cutoff") >= 2003)
    return rows.select("id", "cutoff", status.alias("status"), asof.masked("payoff_chapter", "cutoff").alias("payoff_chapter"), (F.col("cutoff") - F.col("foreshadow_chapter")).alias("age_chapters"))


@query(f"with {_COMMIT} select novel, id, foreshadow_chapter, case when novel < 5 and payoff_chapter >= 1999 then 'pending' else status end as status, case when novel >= 5 or payoff_chapter < 1999 then payoff_chapter end as payoff_chapter from cm where novel >= 5 or foreshadow_chapter < 1999")
def rewound_commitments(spark, sf):
    points = spark.createDataFrame([(n, 1999) for n in range(5)], "novel long, from_chapter int")
    return ingest.unpaid(commitments(spark, sf), points)


@query("""with f as (select o_orderkey as id, year(o_orderdate)::int as chapter, o_orderstatus <> 'O' as resolved, case when o_orderstatus = 'F' then (year(o_orderdate) + 1)::int end as anchor from orders), k(cutoff, uncapped) as (values (1997, false), (2001, true))
select id, cutoff, resolved and case when anchor is not null then anchor <= cutoff else uncapped end as resolved from f, k where chapter <= cutoff""")
def flags_at_cutoffs(spark, sf):
    year = F.year("o_orderdate")
    rows = bind.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), year.alias("chapter"), (F.col("o_orderstatus") != "O").alias("resolved"), F.when(F.col("o_orderstatus") == "F", year + 1).alias("anchor"))
    rows = rows.crossJoin(F.broadcast(spark.createDataFrame([(1997, False), (2001, True)], "cutoff int, uncapped boolean"))).where("chapter <= cutoff")
    return rows.select("id", "cutoff", reads.flag_resolved_at(F.col("resolved"), F.col("anchor"), F.col("cutoff"), F.col("uncapped")).alias("resolved"))


@query("select c_custkey as novel, coalesce(max(year(o_orderdate)), 0)::int as max_chapter, count(o_orderkey) as n_chapters from customer left join orders on c_custkey = o_custkey group by 1")
def novel_summary(spark, sf):
    last = bind.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("last"), F.count("*").alias("n"))
    novels = bind.table(spark, sf, "customer").select(F.col("c_custkey").alias("novel"))
    return novels.join(last, F.col("novel") == F.col("o_custkey"), "left").select("novel", F.coalesce("last", F.lit(0)).alias("max_chapter"), F.coalesce("n", F.lit(0)).alias("n_chapters"))


@query("with x as (select o_custkey as novel, year(o_orderdate)::int - 1994 as number from orders), y as (select *, row_number() over (partition by novel order by number)::int as expected from x) select novel, number, expected from y where number <> expected")
def noncontiguous_chapters(spark, sf):
    rows = bind.table(spark, sf, "orders").select(F.col("o_custkey").alias("novel"), (F.year("o_orderdate") - 1994).alias("number"))
    return ingest.check_contiguous(rows)


@query("with e as (select c_custkey as entity, c_name as name, case when c_custkey % 4 <> 0 then (c_custkey % 7 + 1994)::int end as first from customer), k(cutoff) as (values (1996), (1998), (2000)) select entity, name, cutoff from e, k where first is null or first <= cutoff")
def entities_at_cutoffs(spark, sf):
    first = F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 7 + 1994).cast("int"))
    rows = bind.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), first.alias("first_appearance"))
    return reads.list_entities(rows, cutoffs(spark)).select("entity", "name", "cutoff")


@query("select c_custkey as entity, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as has_pending from customer")
def members_with_pending(spark, sf):
    """Membership by a left semi and a left anti join."""
    entities, pending = bind.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), bind.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("entity"))
    return entities.join(pending, "entity", "left_semi").withColumn("has_pending", F.lit(True)).unionByName(entities.join(pending, "entity", "left_anti").withColumn("has_pending", F.lit(False)))


_DRAFTS = "dr as (select o_orderkey as draft, o_custkey as chapter, case o_orderpriority when '1-URGENT' then 'fail' when '2-HIGH' then 'error' when '3-MEDIUM' then 'unavailable' when '5-LOW' then 'unreviewable' else 'ok' end as verdict from orders)"


def drafts(spark, sf):
    p = F.col("o_orderpriority")
    verdict = F.when(p == "1-URGENT", "fail").when(p == "2-HIGH", "error").when(p == "3-MEDIUM", "unavailable").when(p == "5-LOW", "unreviewable").otherwise("ok")
    return bind.table(spark, sf, "orders").select(F.col("o_orderkey").alias("draft"), F.col("o_custkey").alias("chapter"), verdict.alias("verdict"))


@query(f"with {_DRAFTS}, x as (select *, verdict in ('fail','error','unreviewable') as parked from dr) select draft, chapter, verdict, case when verdict = 'unavailable' then 'refused' when not parked then 'accepted' when row_number() over (partition by chapter, parked order by draft desc) = 1 then 'pending' else 'superseded' end as state from x")
def draft_queue(spark, sf):
    return checks.draft_queue(drafts(spark, sf), ["chapter"], ["draft"])


@query(f"with {_DRAFTS}, x as (select *, verdict in ('fail','error','unreviewable') as parked from dr), y as (select chapter, max(draft) as draft from x where parked group by 1) select (chapter % 10)::bigint as novel, count(*) as pending from y group by 1")
def pending_count(spark, sf):
    return draft_queue(spark, sf).where("state = 'pending'").groupBy((F.col("chapter") % 10).alias("novel")).agg(F.count("*").alias("pending"))


@query(f"with {_DRAFTS} select chapter, max(draft) as draft, 'ok' as verdict from dr where verdict = 'ok' group by 1")
def latest_reports(spark, sf):
    return checks.latest_reports(drafts(spark, sf), ["chapter"], ["draft"])


@query(f"with {_DRAFTS} select dr.draft, case when dr.draft % 2 = 0 then 'accepted after editing: ' else 'accepted unedited: ' end || l_linenumber || ' ' || l_returnflag as flag from dr join lineitem on l_orderkey = draft where verdict = 'fail' and l_returnflag = 'R'")
def override_flags(spark, sf):
    accepted = drafts(spark, sf).where("verdict = 'fail'").select("draft", (F.col("draft") % 2 == 0).alias("edited"))
    findings = bind.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("draft"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("warn").alias("severity"), F.concat(F.col("l_linenumber").cast("string"), F.lit(" "), F.col("l_returnflag")).alias("message"))
    return checks.override_flags(accepted, findings)


_CANON = """cl as (select o_custkey as subject, o_orderkey as seq, o_orderstatus as value, case when o_orderpriority = '5-LOW' then 1.0 when o_orderkey % 10 = 0 then 1.0 else (o_orderkey % 10) / 10.0 end::double as confidence from orders),
lk as (select o_custkey as subject, min(o_orderkey) as lock_seq from orders where o_custkey % 5 = 0 group by 1),
cx as (select cl.*, lock_seq from cl left join lk using (subject)),
cf as (select subject, arg_max(value, (confidence, seq)) as value, max(confidence) as confidence, arg_max(seq, (confidence, seq)) as seq, max(lock_seq) is not null as locked from cx where lock_seq is null or seq <= lock_seq group by 1)"""


#: The canon of each order's customer before the order.
_BEFORE = """cb0 as (select o_orderkey as draft, o_custkey as subject, arg_max(value, (confidence, seq)) as value, max(lock_seq) as lock_seq from orders join cx on subject = o_custkey and seq < o_orderkey where lock_seq is null or seq <= lock_seq group by all),
cb as (select draft, subject, value, coalesce(lock_seq < draft, false) as locked from cb0)"""


def claims(spark, sf):
    """(claims, locks) of canon."""
    k = F.col("o_orderkey") % 10
    rows = bind.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderpriority") != "5-LOW", k / 10.0).alias("confidence"))
    locked = bind.table(spark, sf, "orders").where("o_custkey % 5 = 0").groupBy(F.col("o_custkey").alias("subject")).agg(F.min("o_orderkey").alias("lock_seq"))
    return rows, locked


def canon(spark, sf):
    rows, locked = claims(spark, sf)
    return folds.fold_canon(rows, ["subject"], locked)


@query(f"with {_CANON} select * from cf")
def canon_facts(spark, sf):
    return canon(spark, sf)[0]


@query(f"with {_CANON} select cx.subject, cx.seq, cx.value, cf.value as canon from cx join cf using (subject) where cf.locked and cx.seq > lock_seq and cx.value <> cf.value")
def canon_contradictions(spark, sf):
    return canon(spark, sf)[1]


@query(f"with {_CANON}, m as (select o_custkey as subject, o_orderkey as seq, 'X' as value from orders where o_orderkey % 13 = 0), al as (select subject, seq, value, confidence, lock_seq, false as manual from cx union all select m.*, 1.0, lock_seq, true from m left join lk using (subject)) select subject, arg_max(value, (confidence, seq, manual)) as value, max(confidence) as confidence from al where manual or lock_seq is null or seq <= lock_seq group by 1")
def corrected_canon(spark, sf):
    """Canon with corrections by hand, which replace any value and pass a lock."""
    rows, locked = claims(spark, sf)
    fixed = bind.table(spark, sf, "orders").where("o_orderkey % 13 = 0").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("seq"), F.lit("X").alias("value"))
    # a correction of a chapter comes after what was extracted from it
    return folds.fold_canon(rows.withColumn("seq", F.col("seq") * 2), ["subject"], locked.withColumn("lock_seq", F.col("lock_seq") * 2), fixed.withColumn("seq", F.col("seq") * 2 + 1))[0].select("subject", "value", "confidence")


@query(f"with {_CANON}, {_BEFORE} select l_orderkey as draft, l_linenumber as line, subject, l_linestatus as claimed, case when locked then 'fail' else 'warn' end as severity from lineitem join cb on l_orderkey = draft where l_linestatus <> value")
def check_canon(spark, sf):
    """Claims of drafts against the canon as of the chapter before."""
    lines, orders = bind.table(spark, sf, "lineitem"), bind.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject"))
    mentions = lines.join(orders, "l_orderkey").select("subject", F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("chapter"), F.col("l_linestatus").alias("claimed"))
    rows, locked = claims(spark, sf)
    known = folds.canon_before(rows, orders.select("subject", F.col("l_orderkey").alias("chapter")), ["subject"], locked)
    return checks.check_canon(mentions, known, ["subject"]).select("draft", "line", "subject", "claimed", "severity")


@query(f"""with {_CANON}, {_BEFORE}, f as (select draft, 'canon' as name, case when locked then 'fail' else 'warn' end as severity from lineitem join cb on l_orderkey = draft where l_linestatus <> value),
g as (select * from f union all select o_orderkey, 'claim_resolution', 'warn' from orders where o_orderkey % 7 = 0),
h as (select draft, count_if(severity = 'fail') as fails, count_if(severity = 'warn') as warns, string_agg(distinct name, ',' order by name) as checks from g group by 1)
select o_orderkey as draft, o_orderkey % 11 <> 0 as reviewable, coalesce(fails, 0) as fails, coalesce(warns, 0) as warns, coalesce(checks, '') as checks, o_orderkey % 11 <> 0 and coalesce(fails, 0) = 0 as passed from orders left join h on draft = o_orderkey""")
def critique_reports(spark, sf):
    all_drafts = bind.table(spark, sf, "orders").select(F.col("o_orderkey").alias("draft"), (F.col("o_orderkey") % 11 != 0).alias("reviewable"))
    findings = check_canon(spark, sf).select("draft", F.lit("canon").alias("check"), "severity")
    return checks.critique(all_drafts, findings, all_drafts.where("draft % 7 = 0"))


@query("select o_custkey as chapter, o_orderkey as seq, case o_orderstatus when 'F' then 'fail' when 'P' then 'warn' else 'info' end as severity, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'P' then 1 else 2 end, o_orderkey)::int as rank from orders")
def findings_in_order(spark, sf):
    severity = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "warn").otherwise("info")
    rows = bind.table(spark, sf, "orders").select(F.col("o_custkey").alias("chapter"), F.col("o_orderkey").alias("seq"), severity.alias("severity"))
    weight = F.when(F.col("severity") == "fail", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return asof.topk(rows, ["chapter"], [weight, F.col("seq")], 1 << 30)
