"""Registered queries: one per operator of SURVEY §2 that yields a table.

Every query reads the driver tables (or views Spark derives from them) whole.
``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the DuckDB
SQL twin when the operator is SQL-expressible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries_content, queries_text, queries_topics, queries_dashboard  # noqa: F401
    from . import queries_feeds, queries_lda  # noqa: F401
