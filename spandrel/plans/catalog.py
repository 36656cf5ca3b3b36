"""All registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from spandrel.plans import changes, graphs, languages, relational, scalar, vectors, windows

MODULES = (relational, windows, scalar, vectors, graphs, changes, languages)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in MODULES:
    QUERIES.update(module.REGISTRY.queries)
    ORACLE_SQL.update(module.REGISTRY.oracles)
