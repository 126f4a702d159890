"""Contracts by hand-made payloads."""

import json

from loreframe.operators import contracts

DELTA = {"kind": "location", "character_name": "Ana", "object_name": None, "location_name": "Inn", "change": None, "attribute": None, "value": None, "quote": "q"}
SCENE = {"scene_index": 0, "pov_character_name": None, "location_name": None, "time_anchor": None, "present_character_names": ["Ana"], "summary": "s", "starts_at_excerpt": "e"}
TIE = {"entity_a": "a", "entity_b": "b", "rel_type": "t", "symmetric": None, "from_chapter": None, "to_chapter": 1, "notes": None}
FACT = {"subject_name": "a", "subject_type": "character", "predicate": "p", "value": "v", "kind": "other", "confidence": 1, "quote": "q"}


def broken(spark, name, payload):
    rows = spark.createDataFrame([(1, name, payload if isinstance(payload, str) or payload is None else json.dumps(payload))], "row_id long, pass string, payload string")
    return {(r.path, r.rule) for r in contracts.violations(rows).collect()}


def test_passes(spark):
    cases = [
        ("chapter_summary", {"summary": "s"}, set()),
        ("chapter_summary", {"summary": " "}, {("summary", "blank")}),
        ("chapter_summary", {}, {("summary", "missing")}),
        ("chapter_summary", {"summary": None, "more": 1}, {("summary", "type"), ("more", "extra")}),
        ("chapter_summary", "not json", {("", "object")}),
        ("chapter_summary", None, {("", "object")}),
        ("chapter_summary", "[1]", {("", "object")}),
        ("unknown_pass", {}, {("", "pass")}),
        ("new_entities", {"characters": [], "locations": [], "factions": [], "objects": []}, set()),
        ("new_entities", {"characters": [{"name": "A", "description": "", "aliases": ["x", "", 3]}], "locations": [7], "factions": {}, "objects": []}, {("characters.0.aliases.1", "blank"), ("characters.0.aliases.2", "type"), ("locations.0", "object"), ("factions", "type")}),
        ("state_deltas", {"state_deltas": [DELTA]}, set()),
        ("state_deltas", {"state_deltas": [DELTA, DELTA | {"location_name": " "}, DELTA | {"kind": "status", "attribute": "goals"}]}, {("state_deltas.1", "kind"), ("state_deltas.2", "kind")}),
        ("state_deltas", {"state_deltas": [DELTA | {"kind": "other", "change": "keep"}]}, {("state_deltas.0.kind", "enum"), ("state_deltas.0.change", "enum")}),
        ("relationship_updates", {"relationship_updates": [TIE, TIE | {"from_chapter": 0, "symmetric": "yes", "to_chapter": 1.5}]}, {("relationship_updates.1.from_chapter", "range"), ("relationship_updates.1.symmetric", "type"), ("relationship_updates.1.to_chapter", "type")}),
        ("scene_segmentation", {"scenes": [SCENE, SCENE | {"scene_index": -1}, SCENE | {"scene_index": None}]}, {("scenes.1.scene_index", "range"), ("scenes.2.scene_index", "type")}),
        ("canon_facts", {"canon_facts": [FACT, FACT | {"confidence": 1.01}, FACT | {"confidence": "1"}, FACT | {"confidence": 0.0}]}, {("canon_facts.1.confidence", "range"), ("canon_facts.2.confidence", "type")}),
    ]
    for name, payload, expected in cases:
        assert broken(spark, name, payload) == expected, (name, payload)


def test_composition(spark):
    rows = [
        (1, "chapter_summary", 'Here it is: {"summary": "s1"} as asked'), (1, "events", json.dumps({"events": [{"description": "d", "event_type": "other"}]})), (1, "commitments", "broken {"),
        (2, "multi_granularity_summaries", json.dumps({"summary_short": "a", "summary_medium": "b", "summary_long": "c"})),
    ]
    got = {r.chapter: r for r in contracts.compose(spark.createDataFrame(rows, "chapter int, pass string, payload string"), ["chapter"]).collect()}
    assert got[1].summary == "s1" and [e.description for e in got[1].events] == ["d"] and got[1].payoffs_delivered == [] and got[1].summary_long == ""
    assert (got[2].summary, got[2].summary_short, got[2].summary_long, got[2].scenes) == ("", "a", "c", [])
    assert set(contracts.PASSES["commitments"]) <= set(got[1].asDict())
