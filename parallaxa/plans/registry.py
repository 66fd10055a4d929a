"""A registry of named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query; `sql` computes the same rows over the same tables, where SQL can."""

        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep

    def merge(self, *others: Registry) -> Registry:
        for other in others:
            for name, f in other.queries.items():
                self.query(name, other.sql.get(name))(f)
        return self
