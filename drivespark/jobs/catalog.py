"""Registered queries and their SQL oracles, by name."""

from __future__ import annotations

from . import queries_aggregates, queries_faults, queries_functions, queries_gnss, queries_outages, queries_relations, queries_roads, queries_routes, queries_sensors, queries_series

_MODULES = (queries_functions, queries_series, queries_aggregates, queries_relations, queries_roads, queries_routes, queries_outages, queries_faults, queries_gnss, queries_sensors)
CASES = {name: case for module in _MODULES for name, case in module.CASES.items()}
QUERIES = {name: query for name, (query, _) in CASES.items()}
ORACLES = {name: sql for name, (_, sql) in CASES.items() if sql}
