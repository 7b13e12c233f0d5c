"""Declared data model: the four-table listening-history snowflake.

``artists(id, name)``, ``albums(id, title, artist_id)``,
``tracks(id, title, album_id)`` and the fact ``plays(timestamp, track_id)``.
Ids are text, timestamps are UTC instants.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ARTISTS = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType(), False)]
)
ALBUMS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("artist_id", T.StringType(), False),
    ]
)
TRACKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("album_id", T.StringType(), False),
    ]
)
PLAYS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("track_id", T.StringType(), True),
    ]
)

TABLE_SCHEMAS = {"artists": ARTISTS, "albums": ALBUMS, "tracks": TRACKS, "plays": PLAYS}

# The nested in-flight record: one play with its three dimension rows.
SCROBBLE = T.StructType(
    [
        T.StructField("artist", ARTISTS),
        T.StructField("album", ALBUMS),
        T.StructField("track", TRACKS),
        T.StructField("play", PLAYS),
    ]
)


@dataclass(frozen=True)
class Snowflake:
    """The four tables as DataFrames. Operators only ever read these."""

    artists: DataFrame
    albums: DataFrame
    tracks: DataFrame
    plays: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def register(self, prefix: str = "") -> None:
        """Expose the four tables as temp views (``prefix`` for attached sets)."""
        for name in TABLE_SCHEMAS:
            self.table(name).createOrReplaceTempView(f"{prefix}{name}")

    def with_plays(self, plays: DataFrame) -> "Snowflake":
        return Snowflake(self.artists, self.albums, self.tracks, plays)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An absent table reads as an empty DataFrame with the declared schema."""
    return spark.createDataFrame([], TABLE_SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project/cast a DataFrame to the declared column order and types."""
    schema = TABLE_SCHEMAS[name]
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def snowflake_from_rows(spark: SparkSession, artists, albums, tracks, plays) -> Snowflake:
    """Build a small snowflake from Python rows (tests and fixtures)."""
    return Snowflake(
        spark.createDataFrame(artists, ARTISTS),
        spark.createDataFrame(albums, ALBUMS),
        spark.createDataFrame(tracks, TRACKS),
        spark.createDataFrame(plays, PLAYS),
    )
