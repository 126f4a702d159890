"""Registered queries and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from loreframe.plans import entity_graph, flows, fulltext, graph, merges, names, payloads, records, search, story, views

_GROUPS = (story, records, graph, search, names, flows, views, fulltext, entity_graph, payloads, merges)
QUERIES: dict = {name: f for group in _GROUPS for name, f in group.QUERIES.items()}
ORACLES: dict = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
