"""A register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """``add`` registers a function under its name; ``sql`` is its DuckDB text, which may use the fixture views."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = fixtures.with_views(sql)
            return f

        return keep
