"""Queries over the driver's tables, one or more for each operator, with the same in SQL.

Each module of this package holds the queries of one area in two dicts."""

from __future__ import annotations

from . import evaluation, joins, quality, scoring, sequences, sources, streaming, trajectory

_AREAS = (evaluation, joins, quality, scoring, sequences, sources, streaming, trajectory)
QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLE_SQL = {name: sql for area in _AREAS for name, sql in area.ORACLE_SQL.items()}
