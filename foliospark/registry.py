"""Queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.derive import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query; `sql` may read the base tables and the derived `views` named."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = duck(sql, views)
        return f

    return keep
