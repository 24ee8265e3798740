"""Collects the queries of a module with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            self.functions[name] = function
            if sql:
                self.sql[name] = sql
            return function

        return add

    def queries(self) -> dict[str, Query]:
        return dict(self.functions)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
