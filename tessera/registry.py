"""All queries of the panel engine, with their DuckDB equivalents."""

from __future__ import annotations

from tessera.queries import base, extras, formulas, panels, portfolios, references, runlogs, scores, summaries

QUERIES = base.QUERIES
ORACLE_SQL = base.SQL
FLAGSHIP = "formula_pool"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "base", "extras", "formulas", "panels", "portfolios", "references", "runlogs", "scores", "summaries"]
