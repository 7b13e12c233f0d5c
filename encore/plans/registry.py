"""Named query catalogue: Spark builders and their DuckDB oracle SQL.

Each entry is a function ``(spark, sf_dir) -> DataFrame`` built from the
operators, plus (where the semantics are SQL-expressible) the equivalent
DuckDB text over the driver's tables. Column names match between the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules fills the two dicts.
    from encore.plans import (  # noqa: F401
        q_catalogue,
        q_export,
        q_ingest,
        q_search,
        q_sql,
        q_stats,
        q_stream,
    )


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(ORACLE_SQL)
