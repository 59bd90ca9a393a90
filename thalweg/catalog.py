"""Every query of the library by name, with its DuckDB SQL."""

from __future__ import annotations

from .plans import queries_diagnostics, queries_network, queries_profile

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (queries_profile, queries_network, queries_diagnostics):
    QUERIES |= _part.Q
    ORACLE_SQL |= _part.O
