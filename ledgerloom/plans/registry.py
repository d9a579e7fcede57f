"""Where queries register themselves, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``f(views)`` under its name; ``sql`` may use the views' names as tables."""

    def add(f):
        from ledgerloom.plans.views import Views, with_views

        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


def words_sql(column: str, words: list[str]) -> str:
    """SQL: whether a column contains any of the words."""
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def count_sql(column: str, words: list[str]) -> str:
    """SQL: how many of the words a column contains."""
    return "(" + " + ".join(f"CAST(contains({column}, '{w.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for w in words) + ")"


def list_sql(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
