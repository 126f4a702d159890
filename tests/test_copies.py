"""Many copies of a text meet once: no step of a query makes a row for each pair of them."""

from pyspark.sql import functions as F

from loreframe.operators import checks, entity, ingest, metrics
from loreframe.plans import names

N = 300


def _nodes(node):
    name = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    yield node
    for x in inner:
        yield from _nodes(x)


def most_rows(df):
    """(rows of df, the most rows that a step of its last job put out)."""
    rows = df.collect()
    counts = [n.metrics().apply("numOutputRows").value() for n in _nodes(df._jdf.queryExecution().executedPlan()) if n.metrics().contains("numOutputRows")]
    return rows, max(counts)


def _names(spark, rows):
    return spark.createDataFrame(rows, "novel long, id long, entity_type string, surface string, is_name boolean")


def test_partial_matches_of_copies(spark):
    refs = spark.createDataFrame([(0, i, "Ann") for i in range(N)] + [(0, N, "bob lee")], "novel long, ref_id long, name string")
    known = _names(spark, [(0, i, "object", f"ann {i}", True) for i in range(N)] + [(0, 999, "object", "bob", True)])
    rows, most = most_rows(entity.resolve_partial(refs, known, ["novel"]))
    assert [(r.ref_id, r.id) for r in rows] == [(N, 999)] and most < 10 * N


def test_links_of_copies(spark):
    updates = spark.createDataFrame([(0, i, " Red fox ran") for i in range(N)] + [(0, N, "a\tb"), (0, N + 1, "\t"), (0, N + 2, None)], "chapter long, update_id long, event_text string")
    events = spark.createDataFrame([(0, i, i, "fox") for i in range(5, N)] + [(0, 900, 900, "red FOX ran"), (0, 901, 901, "x a\tb c")], "chapter long, event_id long, seq long, description string")
    rows, most = most_rows(ingest.link_thread_events(updates, events, ["chapter"]))
    assert {r.update_id: r.event_id for r in rows} == {i: 900 for i in range(N)} | {N: 901, N + 1: 901, N + 2: None} and most < 10 * N


def test_coverage_of_copies(spark):
    schema = "document long, name string"
    want = spark.createDataFrame([(0, "Ann Lee")] * N + [(0, "Bob"), (1, "Cid")], schema)
    have = spark.createDataFrame([(0, "ann  lee")] * N + [(0, "the bob here"), (0, "bob"), (1, "x")], schema)
    rows, most = most_rows(metrics.entity_coverage(want, have, spark.createDataFrame([], "document long, name string, alias string"), "document").orderBy("document"))
    a, b = rows
    assert (a.expected, a.actual, a.matched, a.missing, a.ambiguous) == (N + 1, N + 2, 1, ["ann lee"] * N, ["ann lee"] * N)
    assert a.extra == ["ann lee"] * N + ["the bob here"] and (b.missing, b.extra) == (["cid"], ["x"]) and most < 10 * N


def test_facts_of_copies(spark):
    schema = "who long, fact_id long, fact string"
    facts = spark.createDataFrame([(0, i, "red fox ran home") for i in range(N)] + [(0, N, "blue fox sat still"), (0, N + 1, None)], schema)
    rows, most = most_rows(metrics.score_facts(facts, spark.createDataFrame([(0, i, "the red fox") for i in range(N)], schema), ["who"]))
    assert {r.fact_id: r.matched for r in rows} == {i: True for i in range(N)} | {N: False, N + 1: False} and most < 10 * N


def test_knowledge_of_copies_without_broadcast(spark):
    words = [f"w{i} v{i % 7} u{i % 3}" for i in range(30)]
    claims = spark.createDataFrame([(0, i, 5, "red fox ran home") for i in range(N)] + [(0, N + i, 5, w) for i, w in enumerate(words)], "who long, claim_id long, chapter int, claim string")
    facts = spark.createDataFrame([(0, i % 9, f"{i} red fox ran home") for i in range(N)] + [(0, 1, "w3"), (0, 1, "4 v")], "who long, learned int, fact string")
    df = checks.check_knowledge(claims, facts, ["who"])
    rows, most = most_rows(df)
    assert {r.claim_id for r in rows} == {N + i for i, w in enumerate(words) if "w3" not in w and "4 v" not in w} and most < 50 * N
    # exploded sides grow beyond what the planner knows: they are never gathered on the driver
    assert df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= 4


def test_duplicate_classes_hold_all_pairs(spark):
    e = spark.createDataFrame([(0, i, "object" if i % 2 else "place", "red fox", True) for i in range(8)] + [(0, 3, "object", "red foxes", False), (0, 9, "object", "red foxes", True), (0, 20, "place", "blue whale", True), (0, 20, "place", "blue whales", False), (1, 21, "place", "red fox", True)], "novel long, id long, entity_type string, surface string, is_name boolean")
    told = entity.duplicate_classes(e, ["novel"])
    own = e.select("novel", "surface", "id", F.col("entity_type").alias("t"))
    a, b = own.toDF("novel", "surface_a", "a", "ta"), own.toDF("novel", "surface_b", "b", "tb")
    pairs = told.select("novel", "surface_a", "surface_b", "kind", "score").distinct().join(a, ["novel", "surface_a"]).join(b, ["novel", "surface_b"]).where("a <> b")
    pairs = {(r.novel, min(r.a, r.b), max(r.a, r.b)): r for r in pairs.orderBy("score").collect()}
    want = {(r.novel, r.id_a, r.id_b): r for r in entity.duplicate_pairs(e, ["novel"]).collect()}
    assert pairs.keys() == want.keys() and all(abs(pairs[k].score - want[k].score) < 1e-9 for k in want)
    copies = _names(spark, [(0, i, "object", "red fox", True) for i in range(N)])
    rows, most = most_rows(entity.duplicate_classes(copies, ["novel"]))
    assert {(r.id_a, r.id_b) for r in rows} == {(0, i) for i in range(1, N)} and most < 10 * N
    assert "surface_a" in names.duplicate_pairs(spark, "/root/testdata/sf0.001").columns


def test_unambiguous_matches_of_copies(spark):
    known = _names(spark, [(0, i, "object", "silver harbour", True) for i in range(N)] + [(0, 999, "object", "golden mountain", True)])
    said = spark.createDataFrame([(0, f"silver harbour{c}") for c in "abcdefghijklmnop"] + [(0, "golden mountains")], "novel long, name string")
    rows, most = most_rows(entity.match_unambiguous(said, known, ["novel"]))
    assert [(r.surface, r.id) for r in rows] == [("golden mountains", 999)] and most < 4000
