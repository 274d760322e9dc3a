"""Queries of the training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_budget, queries_canon, queries_lookalike, queries_nearest, queries_residue, queries_scan_noise

_MODULES = [queries_scan_noise, queries_nearest, queries_canon, queries_lookalike, queries_budget, queries_residue]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
