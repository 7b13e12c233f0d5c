"""Sort, top-k, rank and paging.

* Global top-k is ``orderBy(...).limit(k)``, planned as
  ``TakeOrderedAndProject``: each partition keeps its k best rows and only
  those are merged, so no full sort or single-partition shuffle happens.
* Ranks are numbered *after* the limit, so the un-partitioned window sees k rows.
* Top-k per group runs in two rounds: first per ``(group, split bucket)``,
  then per group over at most ``buckets * k`` survivors. A group holding a
  third of all rows is thus spread over ``buckets`` tasks; Spark's
  ``WindowGroupLimit`` additionally trims each map partition to k rows per
  group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.operators.selection import Key
from encore.session import written

DEFAULT_SPLIT_BUCKETS = 64


def top_k(df: DataFrame, order: Sequence[Column], k: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered.limit(int(k)) if k is not None else ordered


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number rows 1..n in ``order``; only for frames already cut to k rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    split_by: Sequence[str],
    rank_col: str | None = None,
    buckets: int = DEFAULT_SPLIT_BUCKETS,
) -> DataFrame:
    """Keep the k first rows of each group under ``order`` (ties broken by ``order``).

    ``split_by`` names columns that spread a group's rows (e.g. an id or the
    timestamp); the first round ranks within ``(group, hash(split_by) % buckets)``.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in split_by]), F.lit(buckets))
    staged = df.withColumn("_split", bucket)
    w1 = Window.partitionBy(*group, "_split").orderBy(*order)
    survivors = staged.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    out = (
        survivors.drop("_rn", "_split")
        .withColumn("_rn", F.row_number().over(w2))
        .filter(F.col("_rn") <= k)
    )
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def positions(df: DataFrame, group: Sequence[str], keys: Sequence[Key], name: str = "position", first: int = 1) -> DataFrame:
    """Number the rows of each group from ``first`` in the order of ``keys``, a group of any size over many tasks.

    Rows are dealt out by ranges of (group, keys) and written once with their range; a range
    numbers its own rows, and the ranges of a group meet as one count each. Groups must not be null.
    """
    order = [k.order for k in keys]
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "positions")
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    numbered = ranged.withColumn("_inside", inside).join(counts, [*group, "_range"])
    return numbered.withColumn(name, (F.col("_before") + F.col("_inside") + (first - 1)).cast("int")).drop("_range", "_inside", "_before")
