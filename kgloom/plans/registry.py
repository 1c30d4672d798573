"""Helpers for plan modules: a query and its SQL twin are registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Doubles at an agreed number of digits, so that the order of a sum doesn't show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
