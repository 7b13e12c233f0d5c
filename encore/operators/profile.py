"""Column profiles and catalogue listings.

A profile rests on one table of counts, a row for each (column, value): it takes one shuffle,
partially aggregated, so a value that fills a column is one row a task. Nulls, blanks and
distinct values are sums over it; the most and least common values are a two-round top-k per
column, so a column with millions of distinct values is never ranked in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.operators.ranking import top_k_per_group


def _as_text(ref: Column, kind: T.DataType) -> Column:
    """A value as text, unlike values as unlike texts."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (ref + F.lit(0).cast(kind)).cast("string")  # -0.0 is 0.0
    if isinstance(kind, T.BinaryType):
        return F.hex(ref)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(ref)
    return ref.cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, count): how often each value, as text, stands in each column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    pairs = [F.struct(F.lit(c).alias("column_name"), _as_text(F.col(f"`{c}`"), kinds[c]).alias("value")) for c in columns or df.columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("count"))


def analyze_columns(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """Q30 profile rows: ``table_name, column_name, total_rows, num_null, num_blank, num_distinct``; an empty table has zeros."""
    n = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("count"))), F.lit(0).cast("long"))
    per = value_counts(df, columns).groupBy("column_name").agg(
        F.sum("count").alias("total_rows"),
        n(F.col("value").isNull()).alias("num_null"),
        n(F.col("value") == "").alias("num_blank"),
        F.count("value").alias("num_distinct"),
    )
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns or df.columns])).alias("column_name"))
    figures = ["total_rows", "num_null", "num_blank", "num_distinct"]
    zero = F.lit(0).cast("long")
    return names.join(per, "column_name", "left").select(
        F.lit(table).alias("table_name"), "column_name", *[F.coalesce(c, zero).alias(c) for c in figures]
    )


def common_values(
    df: DataFrame,
    table: str,
    columns: list[str] | None = None,
    limit: int = 10,
    most: bool = True,
    least: bool = True,
) -> DataFrame:
    """The ``limit`` most and least common values per column (ties by value)."""
    counts = value_counts(df, columns)
    parts = []
    for wanted, kind, by in ((most, "most", F.col("count").desc()), (least, "least", F.col("count").asc())):
        if wanted:
            order = [by, F.col("value").asc_nulls_first()]
            best = top_k_per_group(counts, ["column_name"], order, limit, split_by=["value"], rank_col="rank")
            parts.append(best.withColumn("kind", F.lit(kind)))
    if not parts:
        raise ValueError("ask for the most common values, the least common ones, or both")
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.lit(table).alias("table_name"), "column_name", "kind", "rank", "value", "count")


def analyze_database(tables: dict[str, DataFrame]) -> DataFrame:
    """Q30 without names: the profile of every table."""
    return reduce(DataFrame.unionByName, [analyze_columns(df, name) for name, df in tables.items()])


def common_database(tables: dict[str, DataFrame], limit: int = 10, most: bool = True, least: bool = True) -> DataFrame:
    """Q30 without names: the common values of every table."""
    return reduce(DataFrame.unionByName, [common_values(df, name, None, limit, most, least) for name, df in tables.items()])


def table_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Q33: each table with its row count, column list and schema text."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    n = lambda df: df.select(F.count(F.lit(1))).scalar()
    rows = [
        F.struct(
            F.lit(name).alias("table_name"),
            n(df).alias("row_count"),
            F.lit(", ".join(df.columns)).alias("columns"),
            F.lit(df.schema.simpleString()).alias("schema"),
        )
        for name, df in tables.items()
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def catalog_listing(spark: SparkSession) -> DataFrame:
    """Tables and views the session knows (temp views included)."""
    return spark.sql("SHOW TABLES")
