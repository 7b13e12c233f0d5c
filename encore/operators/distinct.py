"""Mergeable distinct counts by month (A3, R6): stored sketches, and exact reference counts.

Both are kept per month and only ever appended to, so late plays cost what they bring, and a
question about any range of months merges what is stored and reads no play again:

* sketches -- HLL sketches of the artists, albums and tracks played in a month
  (``hll_sketch_agg``); a range is their union, with a relative error of about 1.04 / sqrt(2^lg_k);
* counts -- plays a (month, track), added up over what was appended; a track counts in a range if its
  sum there is above zero, so plays may also be taken back. Albums and artists follow from tracks by
  the hierarchy, level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.operators.store import month_of, read_if_present
from encore.schema import Snowflake

#: Rows of a sketch, as a power of two: a relative error of 0.8 %.
LG_K = 14
KINDS = ("artist", "album", "track")


def _dims(s: Snowflake) -> DataFrame:
    tracks = s.tracks.select(F.col("id").alias("track_id"), "album_id")
    return tracks.join(s.albums.select(F.col("id").alias("album_id"), "artist_id"), "album_id")


def month_sketches(s: Snowflake, lg_k: int = LG_K) -> DataFrame:
    """(month, plays, artist, album, track): the plays of a month and a sketch of each kind.

    Plays are first counted a (month, track), so a hot track enters a sketch once a month and task.
    """
    per = s.plays.groupBy(month_of(F.col("timestamp")).alias("month"), "track_id").agg(F.count(F.lit(1)).alias("n"))
    rows = per.join(_dims(s), "track_id")
    sketch = [F.hll_sketch_agg(f"{k}_id", lg_k).alias(k) for k in KINDS]
    return rows.groupBy("month").agg(F.sum("n").alias("plays"), *sketch)


def month_counts(s: Snowflake) -> DataFrame:
    """(month, track_id, n): plays of a track in a month."""
    return s.plays.groupBy(month_of(F.col("timestamp")).alias("month"), "track_id").agg(F.count(F.lit(1)).alias("n"))


class DistinctCounts:
    """Sketches and counts of a history, in a folder."""

    def __init__(self, spark: SparkSession, path: str, lg_k: int = LG_K):
        self.spark, self.path, self.lg_k = spark, path.rstrip("/"), lg_k

    def add(self, s: Snowflake) -> None:
        """Take in plays that are not in yet, ``s.plays``, with the dimensions that they need."""
        month_sketches(s, self.lg_k).write.mode("append").partitionBy("month").parquet(f"{self.path}/sketches")
        month_counts(s).write.mode("append").partitionBy("month").parquet(f"{self.path}/counts")

    def take_back(self, plays: DataFrame) -> None:
        """Plays that are no more: exact counts go down; sketches cannot, and say at least as much as before."""
        gone = plays.groupBy(month_of(F.col("timestamp")).alias("month"), "track_id").agg((-F.count(F.lit(1))).alias("n"))
        gone.write.mode("append").partitionBy("month").parquet(f"{self.path}/counts")

    def _part(self, name: str, since: str | None, until: str | None) -> DataFrame | None:
        """Months are folders, so a range reads its own."""
        rows = read_if_present(self.spark, f"{self.path}/{name}")
        if rows is None:
            return None
        month = F.col("month").cast("string")
        for bound, keep in ((since, lambda b: month >= b), (until, lambda b: month <= b)):
            rows = rows if bound is None else rows.filter(keep(F.lit(bound)))
        return rows.withColumn("month", month)

    def estimate(self, since: str | None = None, until: str | None = None, by: Column | None = None) -> DataFrame:
        """About how many artists, albums and tracks were played from month ``since`` to ``until`` (yyyy-MM), both included.

        One row, or one for each value of ``by``, an expression of ``month``.
        """
        sketches = self._part("sketches", since, until)
        if sketches is None:
            raise ValueError("nothing has been added yet")
        merged = [F.hll_sketch_estimate(F.hll_union_agg(k)).alias(f"{k}s") for k in KINDS]
        return sketches.groupBy(*([] if by is None else [by.alias("period")])).agg(*merged, F.sum("plays").alias("plays"))

    def exact(self, s: Snowflake, since: str | None = None, until: str | None = None, by: Column | None = None) -> DataFrame:
        """The same, exactly, with the hierarchy of ``s``; plays that were taken back do not count."""
        counts = self._part("counts", since, until)
        if counts is None:
            raise ValueError("nothing has been added yet")
        period = F.lit("all") if by is None else by
        tracks = counts.groupBy(period.alias("period"), "track_id").agg(F.sum("n").alias("n")).filter("n > 0")
        albums = tracks.join(_dims(s), "track_id").groupBy("period", "artist_id", "album_id").agg(
            F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("n")
        )
        artists = albums.groupBy("period", "artist_id").agg(
            F.count(F.lit(1)).alias("albums"), F.sum("tracks").alias("tracks"), F.sum("n").alias("n")
        )
        out = artists.groupBy("period").agg(
            F.count(F.lit(1)).alias("artists"), F.sum("albums").alias("albums"), F.sum("tracks").alias("tracks"), F.sum("n").alias("plays")
        )
        return out.drop("period") if by is None else out
