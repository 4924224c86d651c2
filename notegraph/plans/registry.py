"""All queries and their SQL counterparts of the core library."""

from __future__ import annotations

from notegraph.plans import author, build, catalog, integrity, lint, measure, older, rdf, snapshot, stores

MODULES = [catalog, build, lint, measure, snapshot, author, rdf, older, integrity, stores]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark, d: str):
    """The graph built from the texts, in numbers."""
    return build.build_stats(spark, d)
