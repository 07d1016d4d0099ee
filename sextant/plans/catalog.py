"""Registered queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_entries: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in _entries:
            raise ValueError(f"{name} is registered twice")
        _entries[name] = (query, sql)
        return query

    return add


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _entries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries.items() if sql}
