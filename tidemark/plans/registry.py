"""All registered market queries and their DuckDB twins."""

from __future__ import annotations

from tidemark.plans import decision, facts, marts, resolution, text

MODULES = [marts, decision, text, resolution, facts]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in m.ORACLES.items()}
