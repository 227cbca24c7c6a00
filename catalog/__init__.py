"""Registered queries over the given tables and their DuckDB counterparts."""
from __future__ import annotations

from catalog import corpus, inputs, scoring, tokens

MODULES = [inputs, corpus, tokens, scoring]


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
