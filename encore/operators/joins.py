"""Join building blocks (J1-J5) with plays aggregated before joining.

The fact table is the only thing that grows without bound; dimensions are
joined to plays *after* plays are reduced to one row per key, so the joins
see (at most) one row per track instead of one per play. This also removes
fan-out of the reference's ``LEFT JOIN ... COUNT(DISTINCT)`` shape and takes
a hot track out of the join entirely (partial aggregation collapses it
map-side). Join strategy is left to Catalyst/AQE: dimensions under
``spark.sql.autoBroadcastJoinThreshold`` (a size-checked decision, re-checked
at runtime by AQE) are broadcast, larger ones sort-merge joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.schema import Snowflake


def time_range(plays: DataFrame, since=None, until=None, ts: str = "timestamp") -> DataFrame:
    """Inclusive ``since``/``until`` filter, pushed into the Parquet scan."""
    if since is not None:
        plays = plays.filter(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        plays = plays.filter(F.col(ts) <= F.lit(until).cast("timestamp"))
    return plays


def track_play_stats(plays: DataFrame, *extra_keys: Column | str) -> DataFrame:
    """Plays reduced to ``(track_id, *keys) -> play_count, first_played, last_played``."""
    return plays.groupBy("track_id", *extra_keys).agg(
        F.count(F.lit(1)).alias("play_count"),
        F.min("timestamp").alias("first_played"),
        F.max("timestamp").alias("last_played"),
    )


def track_dims(s: Snowflake) -> DataFrame:
    """Tracks x albums x artists, one row per track with all names and ids."""
    t = s.tracks.select(
        F.col("id").alias("track_id"), F.col("title").alias("track_title"), "album_id"
    )
    al = s.albums.select(
        F.col("id").alias("album_id"), F.col("title").alias("album_title"), "artist_id"
    )
    ar = s.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name"))
    return t.join(al, "album_id").join(ar, "artist_id")


def album_dims(s: Snowflake) -> DataFrame:
    """albums x artists, one row per album."""
    al = s.albums.select(
        F.col("id").alias("album_id"), F.col("title").alias("album_title"), "artist_id"
    )
    ar = s.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name"))
    return al.join(ar, "artist_id")


def joined_track_keys(s: Snowflake) -> DataFrame:
    """``(track_id, album_id, artist_id)`` for tracks whose whole chain exists."""
    t = s.tracks.select(F.col("id").alias("track_id"), "album_id")
    al = s.albums.select(F.col("id").alias("album_id"), "artist_id")
    ar = s.artists.select(F.col("id").alias("artist_id"))
    return t.join(al, "album_id").join(ar, "artist_id", "left_semi")
