"""All queries of the document engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from tessella.plans import budgets, files, pages, readings, records, rendering, reports, state, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (budgets, texts, pages, files, state, records, reports, rendering, readings):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
