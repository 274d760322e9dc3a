"""All queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_checks, queries_media, queries_rejects, queries_series

_MODULES = [queries_checks, queries_media, queries_series, queries_rejects]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
