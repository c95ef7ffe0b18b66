"""Registered queries over the driver tables, each with an equivalent SQL
oracle for an independent engine (DuckDB).

The driver tables hold no job postings, so each operator is aimed at
equivalent columns (documents as listings, pages as crawled pages, events as
board moves, orders/lineitem as listing rows and score items).  Every query
reads whole tables; nothing is sampled, capped or filtered by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return deco


def sql_of(name: str) -> str:
    """SQL of a query registered before."""
    return _SQL[name]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load():
    # Importing the modules registers their queries.
    from vetline.plans import q_intake, q_scoring, q_board, q_pages, q_rules, q_cover, q_stored  # noqa: F401
