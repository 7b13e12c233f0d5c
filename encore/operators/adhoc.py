"""Ad-hoc SQL, row browsing and file queries.

User SQL runs through ``spark.sql`` with named parameters bound by Spark
(never string-spliced). Sort specifications for row browsing are validated
against the table's columns before they reach SQL.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.operators.store import SnowflakeStore
from encore.schema import Snowflake

_ORDER_ITEM = re.compile(r"^\s*(`[^`]+`|\[[^\]]+\]|\"[^\"]+\"|[A-Za-z_][A-Za-z0-9_]*)\s*(asc|desc)?\s*$", re.I)


def register_snowflake(s: Snowflake, prefix: str = "") -> None:
    """Temp views ``{prefix}artists`` etc.; ``prefix`` gives attached sets."""
    s.register(prefix)


def attach(spark: SparkSession, alias: str, root: str) -> Snowflake:
    """The store at ``root`` as the views ``{alias}_artists`` etc., beside whatever is registered already."""
    s = SnowflakeStore(spark, root).read()
    register_snowflake(s, f"{alias}_")
    return s


def register_functions(spark: SparkSession, functions: dict[str, Callable], return_type="string") -> None:
    """User SQL functions from Python callables (no code text is executed)."""
    for name, fn in functions.items():
        spark.udf.register(name, fn, return_type)


def sql_query(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """SQL over the registered views with ``:name`` parameters."""
    return spark.sql(query, args=params or {})


def parse_order(order: str, columns: list[str]) -> list:
    """``col [ASC|DESC], ...`` only, every column known; else ValueError."""
    items = []
    for part in order.split(","):
        m = _ORDER_ITEM.match(part)
        if not m:
            raise ValueError(f"Invalid order clause: {order!r}")
        name = m.group(1).strip("`[]\"")
        if name not in columns:
            raise ValueError(f"Unknown column in order clause: {name}")
        col = F.col(f"`{name}`")
        items.append(col.desc() if (m.group(2) or "").lower() == "desc" else col.asc())
    return items


def table_rows(
    spark: SparkSession,
    table: str,
    columns: list[str] | None = None,
    where: str | None = None,
    order: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
    params: dict | None = None,
) -> DataFrame:
    """Q32: one table's projected, filtered, ordered page.

    ``where`` is a SQL predicate that may use ``:name`` parameters (bound by
    Spark); columns are checked (P8) and quoted with backticks (S7).
    """
    df = spark.table(table)
    if where:
        df = spark.sql(f"SELECT * FROM {table} WHERE {where}", args=params or {})
    if columns:
        unknown = [c for c in columns if c not in df.columns]
        if unknown:
            raise ValueError(f"Invalid column(s): {', '.join(unknown)}")
    if order:
        df = df.orderBy(*parse_order(order, df.columns))
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    if offset:
        df = df.offset(int(offset))
    if limit is not None:
        df = df.limit(int(limit))
    return df


def load_files(
    spark: SparkSession,
    paths: list[str],
    detect_types: bool = True,
    encoding: str | None = None,
    flatten: bool = False,
) -> dict[str, DataFrame]:
    """CSV/TSV/JSON files as temp views named after the file stem."""
    from encore.sources.files import flatten_struct

    views = {}
    for path in paths:
        stem, ext = os.path.splitext(os.path.basename(path.rstrip("/")))
        ext = ext.lower()
        if ext in (".json", ".jsonl", ".ndjson"):
            df = spark.read.option("encoding", encoding or "UTF-8").json(path)
        else:
            reader = spark.read.option("header", True).option("inferSchema", detect_types)
            if encoding:
                reader = reader.option("encoding", encoding)
            df = reader.option("sep", "\t" if ext == ".tsv" else ",").csv(path)
        if flatten:
            df = flatten_struct(df)
        name = re.sub(r"\W", "_", stem)
        if name in views:
            raise ValueError(f"two files would both be the table {name}")
        df.createOrReplaceTempView(name)
        views[name] = df
    return views


def files_query(
    spark: SparkSession,
    paths: list[str],
    query: str,
    params: dict | None = None,
    **read_opts,
) -> DataFrame:
    """Q35: SQL over ad-hoc files."""
    load_files(spark, paths, **read_opts)
    return spark.sql(query, args=params or {})
