"""Names for queries."""

from __future__ import annotations


class Registry:
    """Queries, each with the DuckDB SQL that gives the same rows."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def put(function):
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function

        return put
