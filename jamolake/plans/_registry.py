"""Queries and their SQL, registered side by side."""

from __future__ import annotations


def registry():
    """(queries, oracles, decorator): @query(name, sql) registers a function of (spark, sf_dir)."""
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return add

    return queries, oracles, query
