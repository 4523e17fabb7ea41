"""A module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Collects callables of (spark, sf_dir) and, where SQL expresses them, the text for DuckDB."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = f
        if sql is not None:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None):
        def keep(f):
            self.add(name, f, sql)
            return f

        return keep
