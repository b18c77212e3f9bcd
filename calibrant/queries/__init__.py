"""Registered queries over the fixture tables, with DuckDB oracles."""

from __future__ import annotations

from calibrant.queries import corpus, detectors, graph, relational, stats, texts

_PARTS = (relational, texts, corpus, detectors, stats, graph)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
