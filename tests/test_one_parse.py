"""A payload is parsed once for all of its rules."""

from loreframe.operators import contracts
from loreframe.plans import payloads


def test_payloads_are_read_once(spark):
    """each kind of rule read and parsed all payloads again."""
    rows = spark.createDataFrame([(1, "events", '{"events": [3, {"zz": 1}]}'), (2, "gone", "{}"), (3, "chapter_summary", "[]"), (4, None, None), (5, "chapter_summary", None)], "row_id long, pass string, payload string")
    out = contracts.violations(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Generate explode") == 2  # of records, and of what is broken
    got = sorted((r.row_id, r.path, r.rule) for r in out.collect())
    assert [x for x in got if x[0] > 1] == [(2, "", "pass"), (3, "", "object"), (4, "", "pass"), (5, "", "object")]
    assert {(1, "events.0", "object"), (1, "events.1.zz", "extra"), (1, "events.1.description", "missing")} <= set(got)


def test_counts_of_parts_that_come_twice(spark, tmp_path):
    """As the join of violations and payloads by row_id has it: two equal parts count four times."""
    part = spark.createDataFrame([(14, "a b"), (53, "c d"), (53, "c d")], "p_partkey long, p_name string")
    part.write.parquet(f"file://{tmp_path}/part.parquet")
    rows = payloads.payloads(spark, f"file://{tmp_path}")
    met = contracts.violations(rows).join(rows.select("row_id", "pass"), "row_id").collect()
    got = {(r["pass"], r["rule"]): (r.n, r.n_payloads) for r in payloads.violation_counts(spark, f"file://{tmp_path}").collect()}
    assert got and got == {k: (len(own := [r for r in met if (r["pass"], r["rule"]) == k]), len({r.row_id for r in own})) for k in got}
    assert sum(n for n, _ in got.values()) == len(met)


def test_parts_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """a part file of few bytes was one task."""
    spark.range(1, 101).selectExpr("id as p_partkey", "'a b' as p_name").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    monkeypatch.setattr(payloads, "TASK_PARTS", 10)
    rows = payloads.payloads(spark, f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() == 11 and rows.count() == 100
