"""Connected components of an edge list, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (two long columns): the smallest node reachable.

    Alternates large-star and small-star until the edges stay the same: then they are stars whose
    centres are the components. Every round is written to the shared folder, so a lost executor
    costs one round; rounds grow with the logarithm of a component's size. Null ends and loops
    are ignored; an empty edge list has no nodes.
    """
    u, v = edges.columns[:2]
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct()
    now, seen = stored(now, "edges"), None
    while True:
        size = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if size == seen:
            break
        seen = size
        star = _large_star(now).filter("u <> v").distinct()
        now = stored(_small_star(star).filter("u <> v").distinct(), "edges")
    hung = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return hung.union(hung.select("component", "component")).distinct()
