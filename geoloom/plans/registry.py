"""A list of queries with their oracle SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, oracle: str | None = None):
        """Register a function under its name, with DuckDB SQL for the same rows."""

        def add(f):
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add
