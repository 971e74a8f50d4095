"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Query functions by name, each with optional SQL for the same result."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        """Decorator that registers a function under ``name``."""

        def add(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add
