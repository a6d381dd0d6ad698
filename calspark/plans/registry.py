"""Registered queries: a function of the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, duck

#: The time that point-in-time queries take for now.
NOW = "2024-01-15 12:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables`` under a name; ``sql`` is for DuckDB over the same tables and views."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck(sql.replace("$NOW", f"TIMESTAMP '{NOW}'"))
        return f

    return register
