"""Story edges: counted by hash, with one label from several sources and places that are missing."""

from loreframe.operators import reads


def test_edges_are_counted_by_hash(spark):
    rows = [
        (0, 2, 1, "event", "met", 5), (0, 1, 2, "dynamic", "met", 9), (0, 1, 2, "event", "met", 3), (0, 1, 2, "event", "fell", 4), (0, 1, 2, "location", "here", 1), (0, 1, 2, "event", None, 7),
        (0, 3, 4, "possession", "b", 2), (0, 3, 4, "possession", "a", 2), (0, 3, 4, "possession", "z", None), (1, 1, 2, "place", "x", 1), (1, 1, 2, "location", "x", 1),
    ]
    out = reads.merge_story_edges(spark.createDataFrame(rows, "novel long, a long, b long, source string, label string, seq long"), ["novel"], ["seq"])
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 2, "dynamic", "4 kinds", "met\nfell\nhere"), (0, 3, 4, "possession", "3 kinds", "z\na\nb"), (1, 1, 2, "location", "x", "x")]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
