"""Contracts of extraction payloads: one declaration gives the schema that reads a pass's JSON and the rules that it must keep.

A payload is one JSON object a pass and chapter. It is taken apart into records (the object itself, and the elements of its lists
of records), each with its keys and their types as they stand in the JSON; rules are a small table that these meet on
(pass, list), and a record's are told in its row: a payload is parsed once. So all passes are checked in one scan, and a payload that from_json would read by
bending it (a number for a text, a key too many) is told by path and rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """What a field holds. type: text (not blank), string, one_of, whole, share (0 to 1), flag, names (texts), records."""

    type: str
    null: bool = False
    values: tuple[str, ...] = ()
    least: int | None = None
    fields: dict[str, Kind] = field(default_factory=dict, hash=False)
    #: By the value of a record's ``kind``: which of its fields may not be blank.
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    required: bool = True


def one_of(*values: str, null: bool = False) -> Kind:
    return Kind("one_of", null, values)


def records(needs: dict[str, tuple[str, ...]] | None = None, required: bool = True, **fields: Kind) -> Kind:
    return Kind("records", fields=fields, needs=needs or {}, required=required)


TEXT, STRING, MAYBE, NAMES, FLAG, SHARE, CHAPTER = Kind("text"), Kind("string"), Kind("string", True), Kind("names"), Kind("flag", True), Kind("share"), Kind("whole", True, least=1)

#: The passes with their fields; fixed values.
PASSES: dict[str, dict[str, Kind]] = {
    "chapter_summary": {"summary": TEXT},
    "new_entities": {
        "characters": records(name=TEXT, description=STRING, aliases=NAMES),
        "locations": records(name=TEXT, description=STRING, parent_location=MAYBE),
        "factions": records(name=TEXT, description=STRING),
        "objects": records(name=TEXT, description=STRING, owner_name=MAYBE, distinguishing_properties=MAYBE, significance=MAYBE),
        "custom_entities": records(required=False, name=TEXT, description=STRING, type=TEXT),
    },
    "state_deltas": {
        "state_deltas": records(
            needs={"possession": ("object_name", "change"), "location": ("location_name",), "status": ("attribute", "value")},
            kind=one_of("possession", "location", "status"), character_name=TEXT, object_name=MAYBE, location_name=MAYBE, change=one_of("gain", "loss", null=True),
            attribute=one_of("emotional_state", "goals", "physical_state", "appearance", "notes", null=True), value=MAYBE, quote=TEXT,
        )
    },
    "events": {
        "events": records(
            description=TEXT, event_type=one_of("action", "revelation", "death", "arrival", "conflict", "other"), impact_level=one_of("low", "medium", "high", "critical"),
            involved_characters=NAMES, involved_locations=NAMES, involved_objects=NAMES, involved_factions=NAMES,
        )
    },
    "thread_updates": {
        "thread_updates": records(
            title=TEXT, description=STRING, status=one_of("open", "progressing", "closed"), impact=one_of("opens", "advances", "closes"),
            thread_type=one_of("mystery", "conflict", "goal", "prophecy", "secret", "other"), event_description=STRING,
        )
    },
    "continuity_flags": {"continuity_flags": records(description=TEXT, flag_type=one_of("foreshadowing", "planted_detail", "setup", "callback", "other"))},
    "relationship_updates": {"relationship_updates": records(entity_a=TEXT, entity_b=TEXT, rel_type=TEXT, symmetric=FLAG, from_chapter=CHAPTER, to_chapter=CHAPTER, notes=MAYBE)},
    "dynamics_updates": {"dynamics_updates": records(entity_a=TEXT, entity_b=TEXT, description=TEXT)},
    "scene_segmentation": {
        "scenes": records(scene_index=Kind("whole", least=0), pov_character_name=MAYBE, location_name=MAYBE, time_anchor=MAYBE, present_character_names=NAMES, summary=TEXT, starts_at_excerpt=TEXT)
    },
    "multi_granularity_summaries": {"summary_short": TEXT, "summary_medium": TEXT, "summary_long": TEXT},
    "knowledge_state_deltas": {
        "learnings": records(
            character_name=TEXT, fact_description=TEXT, source_type=one_of("dialogue", "observation", "inference", "witnessed", "told", "assumed"),
            source_character_name=MAYBE, certainty=one_of("high", "medium", "low"), shared_with_character_names=NAMES,
        )
    },
    "commitments": {
        "foreshadows_introduced": records(foreshadow_text=TEXT, trigger_predicate=TEXT, weight=one_of("low", "medium", "high"), related_entity_names=NAMES),
        "payoffs_delivered": records(payoff_text=TEXT, matches_foreshadow=STRING),
    },
    "canon_facts": {
        "canon_facts": records(
            subject_name=TEXT, subject_type=one_of("character", "location", "object", "faction"), predicate=TEXT, value=TEXT,
            kind=one_of("physical", "relational", "world_rule", "backstory", "other"), confidence=SHARE, quote=TEXT,
        )
    },
}

_TYPES = {"text": "string", "string": "string", "one_of": "string", "whole": "int", "share": "double", "flag": "boolean", "names": "array<string>"}


def schema(fields: dict[str, Kind]) -> str:
    """The DDL that reads a pass."""
    own = lambda k: f"array<struct<{', '.join(f'{n}:{_TYPES[x.type]}' for n, x in k.fields.items())}>>" if k.type == "records" else _TYPES[k.type]
    return ", ".join(f"{name} {own(kind)}" for name, kind in fields.items())


def _groups(passes: dict[str, dict[str, Kind]]) -> list[tuple[str, str, dict[str, Kind], dict]]:
    """(pass, list, fields, needs): the object of each pass (list ``''``) and each of its lists of records."""
    return [(p, "", fields, {}) for p, fields in passes.items()] + [(p, n, k.fields, k.needs) for p, fields in passes.items() for n, k in fields.items() if k.type == "records"]


def rule_rows(passes: dict[str, dict[str, Kind]] = PASSES) -> list[tuple]:
    """(pass, list, key, type, null, values, least, required) of every field."""
    return [(p, g, n, k.type, k.null, list(k.values), k.least, k.required) for p, g, fields, _ in _groups(passes) for n, k in fields.items()]


def violations(rows: DataFrame, row_id: str = "row_id", pass_col: str = "pass", payload: str = "payload", passes: dict[str, dict[str, Kind]] = PASSES) -> DataFrame:
    """(row_id, path, rule) for every rule that a payload breaks.

    Rules: object (not a JSON object), missing, extra, type, blank, enum, range, kind (a field that the record's kind needs is
    blank). A payload or element that is no object has that one violation. An unknown pass has rule ``pass``.
    """
    spark = rows.sparkSession
    lists = F.broadcast(spark.createDataFrame([(p, [n for n, k in f.items() if k.type == "records"]) for p, f in passes.items()], "pass string, lists array<string>"))
    kinds = lambda f: {n: (k.type, k.null, list(k.values), k.least) for n, k in f.items()}
    known = [(p, g, sorted(f), sorted(n for n, k in f.items() if k.required), {k: list(v) for k, v in needs.items()}, kinds(f)) for p, g, f, needs in _groups(passes)]
    groups = F.broadcast(spark.createDataFrame(known, "pass string, list string, declared array<string>, required array<string>, needs map<string,array<string>>, kinds map<string,struct<type:string,null:boolean,values:array<string>,least:int>>"))
    is_object = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
    told = lambda path, rule: F.struct(path.alias("path"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))
    none = F.array().cast("array<struct<path:string,rule:string>>")
    whole = rows.select(F.col(row_id).alias("row_id"), F.col(pass_col).alias("pass"), F.try_parse_json(F.col(payload)).alias("v")).join(lists, "pass", "left")
    # the object itself and the elements of its lists, each a row of one pass over the payloads
    record = lambda of, path, v: F.struct(of.alias("list"), path.alias("path"), v.alias("v"))
    held = F.filter(F.map_entries(F.col("v").cast("map<string,variant>")), lambda e: F.array_contains("lists", e["key"]) & F.schema_of_variant(e["value"]).startswith("ARRAY"))
    elements = F.flatten(F.transform(held, lambda e: F.transform(e["value"].cast("array<variant>"), lambda x, i: record(e["key"], F.concat_ws(".", e["key"], i.cast("string")), x))))
    top = F.array(record(F.lit(""), F.lit(""), F.col("v")))
    each = whole.select("row_id", "pass", F.explode(F.when(F.col("lists").isNotNull() & is_object("v"), F.concat(top, elements)).otherwise(top)).alias("r")).select("row_id", "pass", "r.*")
    each = each.join(groups, ["pass", "list"], "left").withColumn("m", F.when(is_object("v"), F.col("v").cast("map<string,variant>")))
    under = lambda *parts: F.concat_ws(".", F.nullif("path", F.lit("")), *parts)
    as_text = lambda v: F.trim(F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit("")))
    wanted = F.element_at("needs", as_text(F.try_element_at("m", F.lit("kind"))))
    lacks = (F.size("needs") > 0) & F.exists(wanted, lambda n: as_text(F.try_element_at("m", n)) == "")
    values = F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v"), F.schema_of_variant(e["value"]).alias("t"), F.try_element_at("kinds", e["key"]).alias("k")))

    def broken(e):
        kind, t, text, amount = e["k"]["type"], e["t"], F.try_variant_get(e["v"], "$", "string"), F.try_variant_get(e["v"], "$", "double")
        whole_number = (t == "BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)$")
        number = whole_number | t.rlike("^(DECIMAL|DOUBLE|FLOAT)")
        fits = (
            F.when(kind.isin("text", "string", "one_of"), t == "STRING").when(kind == "whole", whole_number).when(kind == "share", number)
            .when(kind == "flag", t == "BOOLEAN").otherwise(t.startswith("ARRAY"))
        )
        return (
            F.when((t == "VOID") & e["k"]["null"], None).when(~fits, "type").when((kind == "text") & (F.trim(text) == ""), "blank")
            .when((kind == "one_of") & ~F.array_contains(e["k"]["values"], text), "enum").when((kind == "whole") & (amount < e["k"]["least"]), "range")
            .when((kind == "share") & ((amount < 0) | (amount > 1)), "range")
        )

    def names(e):
        rule = lambda x: F.when(F.schema_of_variant(x) != "STRING", "type").when(F.trim(F.try_variant_get(x, "$", "string")) == "", "blank")
        listed = F.when((e["k"]["type"] == "names") & e["t"].startswith("ARRAY"), e["v"].cast("array<variant>"))
        return F.coalesce(F.transform(listed, lambda x, i: told(under(e["key"], i.cast("string")), rule(x))), none)

    keys = F.map_keys("m")
    rules = F.concat(
        F.transform(F.array_except("required", keys), lambda k: told(under(k), "missing")),
        F.transform(F.array_except(keys, "declared"), lambda k: told(under(k), "extra")),
        F.when(lacks, F.array(told(F.col("path"), "kind"))).otherwise(none),
        F.flatten(F.transform(F.filter(values, lambda e: e["k"].isNotNull()), lambda e: F.concat(F.array(told(under(e["key"]), broken(e))), names(e)))),
    )
    found = F.when(F.col("kinds").isNull(), F.array(told(F.lit(""), "pass"))).when(F.col("m").isNull(), F.array(told(F.col("path"), "object"))).otherwise(rules)
    return each.select("row_id", F.explode(found).alias("b")).where("b.rule is not null").select("row_id", "b.path", "b.rule")


def compose(rows: DataFrame, keys: list[str], pass_col: str = "pass", payload: str = "payload", passes: dict[str, dict[str, Kind]] = PASSES) -> DataFrame:
    """keys and one column for every field of every pass: a chapter's payloads as one record.

    Payloads are read leniently, from their first brace to their last; what a pass lacks, or all of it where it can't be read or
    wasn't delivered, is an empty text or list. Of several payloads of one pass the greatest counts.
    """
    grouped = rows.groupBy(*keys).agg(*[F.max(F.when(F.col(pass_col) == p, F.col(payload))).alias(f"_{p}") for p in passes])
    read = grouped.select(*keys, *[F.from_json(F.regexp_extract(F.coalesce(f"_{p}", F.lit("{}")), r"(?s)\{.*\}", 0), schema(fields)).alias(f"_{p}") for p, fields in passes.items()])
    columns = []
    for p, fields in passes.items():
        for name, kind in fields.items():
            own = F.col(f"_{p}.{name}")
            empty = F.array().cast(f"array<struct<{', '.join(f'{n}:{_TYPES[x.type]}' for n, x in kind.fields.items())}>>") if kind.type == "records" else F.lit("")
            columns.append(F.coalesce(own, empty).alias(name))
    return read.select(*keys, *columns)
