"""Registered queries: each runs over whole tables, most with an SQL text of the same meaning."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``(spark, sf_dir)`` under a name, with its SQL where there is one."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_all():
    from vecspark.registry import functions, graphs, indexes, search  # noqa: F401
    return QUERIES, ORACLES
