"""Registration of queries with their SQL."""

from __future__ import annotations


def registry():
    """(queries, oracles, decorator): the decorator takes the SQL, or None where SQL can't express the query."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
