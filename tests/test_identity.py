"""Merges over tables and payloads, by hand."""

from loreframe.operators import graphs, identity, pages

PAYLOAD = "struct<name:string,aliases:array<string>,place:bigint,members:array<bigint>,first:int>"


def test_entities_know_what_they_absorb(spark):
    e = spark.createDataFrame([(1, "Ana", ["A", "ANNA"]), (2, "Anna", ["A", "Nan", ""]), (3, "ana", None), (4, "Bo", ["B"])], "id long, name string, aliases array<string>")
    got = {r.id: r.aliases for r in identity.merged_entities(e, spark.createDataFrame([(2, 1), (3, 1)], "source long, target long")).collect()}
    assert got == {1: ["A", "ANNA", "Nan", "Anna"], 4: ["B"]}


def test_relationships(spark):
    schema = "id long, a long, b long, rel_type string, mutual boolean, from_chapter int, to_chapter int, notes string, successor long"
    rows = [
        (1, 1, 5, "r", False, 1, None, None, None), (2, 2, 5, "r", False, 1, None, None, None),  # equal once 2 is 1
        (3, 2, 1, "r", False, 1, None, None, None),  # a pair with itself
        (4, 5, 2, "r", False, 1, None, None, None),  # the other direction
        (5, 2, 6, "m", True, 2, None, None, None), (6, 6, 1, "m", True, 2, None, None, None),  # mutual: either direction
        (7, 1, 7, "r", False, 1, None, None, 8), (8, 1, 7, "r", False, 1, 4, None, None), (9, 2, 7, "r", False, 1, 4, None, None),  # a successor stays, though equal
        (10, 5, 6, "r", False, 1, None, None, None), (11, 5, 6, "r", False, 1, None, None, None),  # not of the target
        (12, 2, 8, "r", False, 1, None, "x", None), (13, 1, 8, "r", False, 1, None, None, None),
    ]
    got = identity.merged_relationships(spark.createDataFrame(rows, schema), spark.createDataFrame([(2, 1)], "source long, target long"))
    assert sorted((r.id, r.a, r.b) for r in got.collect()) == [(1, 1, 5), (4, 5, 1), (5, 1, 6), (7, 1, 7), (8, 1, 7), (9, 1, 7), (10, 5, 6), (11, 5, 6), (12, 1, 8), (13, 1, 8)]


def test_dynamics_and_canon(spark):
    m = spark.createDataFrame([(2, 1), (3, 1)], "source long, target long")
    d = spark.createDataFrame([(1, 2, 9, 4, "old"), (2, 1, 9, 4, "own"), (3, 3, 9, 5, "c"), (4, 2, 9, 5, "b"), (5, 2, 3, 1, "self")], "id long, a long, b long, chapter int, description string")
    assert sorted((r.id, r.a, r.chapter) for r in identity.merged_dynamics(d, m).collect()) == [(2, 1, 4), (3, 1, 5)]
    c = spark.createDataFrame([(1, 2, "eyes", "blue"), (2, 1, "eyes", "grey"), (3, 3, "hair", "red"), (4, 2, "hair", "black")], "id long, subject long, predicate string, value string")
    assert sorted((r.subject, r.predicate, r.value) for r in identity.merged_canon(c, m).collect()) == [(1, "eyes", "grey"), (1, "hair", "red")]


def test_history(spark):
    e = spark.createDataFrame([(1, "Ana", []), (2, "Anna", []), (7, "Inn", [])], "id long, name string, aliases array<string>")
    p = lambda name, aliases, place, members, first: (name, aliases, place, members, first)
    rows = [
        ("entities", 1, 3, p("Ana", ["x"], None, None, 3)), ("entities", 2, 3, p("Anna", ["y"], None, None, 2)),  # one chapter: the target's, with both aliases
        ("entities", 2, 1, p("Miss A", None, None, None, 5)), ("entities", 2, 6, None), ("entities", 1, 8, None),
        ("scenes", 50, 2, p("s", [], 2, [2, 9, 1, None], None)), ("scenes", 51, 2, p("t", [], None, None, None)), ("notes", 60, 1, p("n", [], 2, [2], None)),
    ]
    versions = spark.createDataFrame(rows, f"tbl string, row long, chapter int, payload {PAYLOAD}")
    paths = {"entities": ((), ()), "scenes": (("place",), ("members",))}
    got = {(r.tbl, r.row, r.chapter): r.payload and tuple(r.payload) for r in identity.merged_history(versions, e, spark.createDataFrame([(2, 1)], "source long, target long"), paths).collect()}
    assert got == {
        ("entities", 1, 3): ("Ana", ["y", "Anna", "x"], None, None, 2), ("entities", 1, 1): ("Ana", ["Miss A", "Anna"], None, None, 5), ("entities", 1, 8): None,
        ("scenes", 50, 2): ("s", [], 1, [1, 9, None], None), ("scenes", 51, 2): ("t", [], None, None, None), ("notes", 60, 1): ("n", [], 2, [2], None),
    }


def test_graph_leaves_out_ends_that_do_not_exist(spark):
    record = "struct<name:string,entity_type:string,first:int>"
    versions = spark.createDataFrame([(1, 10, 1, ("Ana", "character", None)), (1, 10, 5, ("Queen Ana", "character", None)), (1, 11, 1, ("Bo", "character", 4)), (1, 11, 6, None), (1, 20, 1, ("Inn", "place", 1))], f"novel long, entity long, chapter int, payload {record}")
    ties = spark.createDataFrame([(1, 1, 10, 11, "friend_of", None, 1, None, 1, None), (1, 2, 10, 99, "r", None, 1, None, 1, None)], "novel long, id long, a long, b long, rel_type string, mutual boolean, from_chapter int, to_chapter int, asserted int, successor long")
    felt = spark.createDataFrame([(1, 11, 10, "tension", 2, 1)], "novel long, a long, b long, label string, chapter int, seq long")
    events = spark.createDataFrame([(5, 1, 2, "met", [10, 11], [20]), (6, 1, 2, "met", [10, 11], [])], "event long, novel long, chapter int, label string, members array<long>, places array<long>")
    held = spark.createDataFrame([], "novel long, entity long, object long, id long, since int, until int")
    stays = spark.createDataFrame([(1, 10, 20, 1, 1, 1, 2), (1, 10, 20, 2, 1, None, None)], "novel long, entity long, place long, id long, since int, until int, superseded_by long")
    cuts = spark.createDataFrame([(1,), (3,), (7,)], "cutoff int")
    nodes, edges = graphs.entity_graph(cuts, versions, ties, felt, events, held, stays)
    assert sorted((r.cutoff, r.entity, r.name) for r in nodes.collect()) == [(1, 10, "Ana"), (1, 20, "Inn"), (3, 10, "Ana"), (3, 20, "Inn"), (7, 10, "Queen Ana"), (7, 20, "Inn")]
    got = sorted((r.cutoff, r.a, r.b, r.a_name, r.edge_kind, r.label, r.tooltip or "") for r in edges.collect())
    assert got == [
        (1, 10, 11, "Ana", "relationship", "friend_of", ""), (1, 10, 20, "Ana", "location", "is at", "is at"),
        (3, 10, 11, "Ana", "dynamic", "2 kinds", "tension\nmet"), (3, 10, 11, "Ana", "relationship", "friend_of", ""), (3, 10, 20, "Ana", "event", "2 kinds", "met\nis at"), (3, 11, 20, "Bo", "event", "met", "met"),
        (7, 10, 20, "Queen Ana", "event", "2 kinds", "met\nis at"),
    ]
    line = pages.timeline(events, graphs.known_entities(versions, cuts), cuts).where("cutoff = 7").orderBy("position").collect()
    assert [(r.position, r.members, r.places) for r in line] == [(1, ["Queen Ana", "11"], ["Inn"]), (2, ["Queen Ana", "11"], [])]
