"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r4(x: str) -> str:
    """SQL of a double rounded half up to four decimals."""
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"
