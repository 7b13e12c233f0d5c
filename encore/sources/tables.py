"""Table scans (S7, S10) and the two bindings of driver tables to the snowflake.

Binding A maps the already-normalised TPC-H-style tables onto the four roles:
``orders`` are plays (``o_orderdate`` at ``o_custkey``), ``customer`` rows are
tracks, ``nation`` rows albums and ``region`` rows artists. Ids become text.

Binding B (denormalised records from ``lineitem`` x ``part``) goes through the
load path in :mod:`encore.operators.ingest`; see :func:`records_from_lineitem`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.schema import Snowflake, empty_table

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_snowflake_dir(spark: SparkSession, root: str) -> Snowflake:
    """Read a stored snowflake; an absent table reads as empty."""
    from encore.operators.store import read_if_present

    parts = {}
    for name in ("artists", "albums", "tracks", "plays"):
        found = read_if_present(spark, os.path.join(root, name))
        parts[name] = empty_table(spark, name) if found is None else found
    return Snowflake(**parts)


def binding_a(spark: SparkSession, sf_dir: str) -> Snowflake:
    """orders/customer/nation/region as plays/tracks/albums/artists."""
    artists = read_table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name")
    )
    albums = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("title"),
        F.col("n_regionkey").cast("string").alias("artist_id"),
    )
    tracks = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("title"),
        F.col("c_nationkey").cast("string").alias("album_id"),
    )
    plays = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("track_id"),
    )
    return Snowflake(artists, albums, tracks, plays)


# DuckDB text of binding A, prepended to every oracle query on it.
BINDING_A_SQL = """
WITH artists AS (SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region),
albums AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title,
                  CAST(n_regionkey AS VARCHAR) AS artist_id FROM nation),
tracks AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title,
                  CAST(c_nationkey AS VARCHAR) AS album_id FROM customer),
plays AS (SELECT o_orderdate AS "timestamp", CAST(o_custkey AS VARCHAR) AS track_id FROM orders)
"""


def records_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding B: denormalised play records ``(timestamp, artist, album, track)``.

    Each line item is a play of part ``p_name`` on album ``p_type`` by artist
    ``p_brand`` at ``l_shipdate``. The result has the shape of an import file
    row, so it runs through the same parse/normalise/upsert path as files.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").alias("timestamp"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        F.col("p_name").alias("track"),
    )
