"""Registering queries with the DuckDB SQL they are checked against."""


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def query(self, name: str, sql: str | None = None):
        """A decorator: the function takes (spark, folder) and returns a DataFrame."""

        def add(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return add
