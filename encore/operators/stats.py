"""Overview, rollups, filtered history, artist stats, top-N, time ranges.

Plan shape shared by all of them: filter plays by time (pushed into the
scan), aggregate plays to one row per ``(group keys, track_id)`` with partial
(map-side) aggregation, *then* join the reduced rows to the dimensions, then
roll up. Distinct counts over tracks become plain counts because rows are
already unique per track, and those over albums and artists counts level by level.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.operators.joins import (
    joined_track_keys,
    time_range,
    track_dims,
    track_play_stats,
)
from encore.operators.ranking import top_k, top_k_per_group, with_rank
from encore.schema import Snowflake


def _round6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- Q1 overview
def overview_stats(s: Snowflake) -> DataFrame:
    """One row: counts of plays/artists/albums/tracks and the first/last play.

    Each figure is a scalar subquery over its own table (one partial+final
    aggregate each); empty tables give 0 and null.
    """
    spark = s.plays.sparkSession
    n = lambda df: df.select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(
        n(s.plays).alias("total_scrobbles"),
        n(s.artists).alias("unique_artists"),
        n(s.albums).alias("unique_albums"),
        n(s.tracks).alias("unique_tracks"),
        s.plays.select(F.min("timestamp")).scalar().alias("first_scrobble"),
        s.plays.select(F.max("timestamp")).scalar().alias("last_scrobble"),
    )


# ---------------------------------------------------------------- Q2/Q3 rollups
def _rollup(s: Snowflake, keys: list, since, until) -> DataFrame:
    plays = time_range(s.plays, since, until)
    per_track = plays.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per_track.join(joined_track_keys(s), "track_id")
    key_names = [c for c in per_track.columns if c not in ("track_id", "n")]
    return _up_the_hierarchy(joined, key_names)


def _up_the_hierarchy(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per ``keys`` of rows unique by track: a track has one album and an album one artist,
    so each level is a count of the rows of the level below, and no distinct count is needed."""
    per_album = joined.groupBy(*keys, "artist_id", "album_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tracks"))
    per_artist = per_album.groupBy(*keys, "artist_id").agg(
        F.sum("n").alias("n"), F.sum("tracks").alias("tracks"), F.count(F.lit(1)).alias("albums")
    )
    return per_artist.groupBy(*keys).agg(
        F.sum("n").alias("scrobbles"),
        F.count(F.lit(1)).alias("unique_artists"),
        F.sum("albums").alias("unique_albums"),
        F.sum("tracks").alias("unique_tracks"),
    )


def monthly_rollup(s: Snowflake, since=None, until=None, limit: int | None = None) -> DataFrame:
    """Q2: per (year, month) plays and distinct artists/albums/tracks, newest first."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be a positive integer")
    keys = [F.year("timestamp").alias("year"), F.month("timestamp").alias("month")]
    res = _rollup(s, keys, since, until)
    return top_k(res, [F.col("year").desc(), F.col("month").desc()], limit)


def yearly_rollup(s: Snowflake, since=None, until=None, limit: int | None = None) -> DataFrame:
    """Q3: per year; a non-positive limit is ignored (as in the reference)."""
    res = _rollup(s, [F.year("timestamp").alias("year")], since, until)
    k = int(limit) if limit is not None and int(limit) > 0 else None
    return top_k(res, [F.col("year").desc()], k)


# ---------------------------------------------------------------- Q28 totals rows
def with_totals(rollup: DataFrame, group_label: str) -> DataFrame:
    """Q28: append a grand-total row when the (already limited) rollup has >1 group.

    The total row carries the summed plays and the number of groups
    (``group_count``); distinct columns are blank (null) because distinct
    counts do not add up. ``row_kind`` tells rows apart.
    """
    body = rollup.withColumn("row_kind", F.lit(group_label)).withColumn(
        "group_count", F.lit(None).cast("long")
    )
    total = (
        rollup.agg(F.sum("scrobbles").alias("scrobbles"), F.count(F.lit(1)).alias("group_count"))
        .filter(F.col("group_count") > 1)
        .withColumn("row_kind", F.lit("total"))
    )
    return body.unionByName(total, allowMissingColumns=True)


def monthly_totals(s: Snowflake, since=None, until=None, limit=None) -> DataFrame:
    return with_totals(monthly_rollup(s, since, until, limit), "month")


def yearly_totals(s: Snowflake, since=None, until=None, limit=None) -> DataFrame:
    return with_totals(yearly_rollup(s, since, until, limit), "year")


# ---------------------------------------------------------------- Q4 filtered plays
def plays_filtered(
    s: Snowflake,
    limit: int = 20,
    since=None,
    until=None,
    artist: str | None = None,
    album: str | None = None,
    track: str | None = None,
) -> DataFrame:
    """Q4: newest plays with names; AND of optional time and substring filters.

    Name filters are applied to the dimensions before the fact join; the time
    filter reaches the Parquet scan; the newest ``limit`` rows are a
    ``TakeOrderedAndProject`` (per-partition top-k, then merge).
    """
    from encore.functions.text import contains_ci

    dims = track_dims(s)
    if artist:
        dims = dims.filter(contains_ci("artist_name", artist))
    if album:
        dims = dims.filter(contains_ci("album_title", album))
    if track:
        dims = dims.filter(contains_ci("track_title", track))
    plays = time_range(s.plays, since, until)
    rows = plays.join(dims, "track_id").select(
        "timestamp", "artist_name", "track_title", "album_title"
    )
    order = [
        F.col("timestamp").desc(),
        F.col("artist_name"),
        F.col("album_title"),
        F.col("track_title"),
    ]
    return top_k(rows, order, limit)


# ---------------------------------------------------------------- Q5 artists with stats
def artist_rollup(s: Snowflake, since=None, until=None) -> DataFrame:
    """Per artist: plays, distinct tracks/albums, first/last play (inner chain)."""
    per_track = track_play_stats(time_range(s.plays, since, until))
    joined = per_track.join(joined_track_keys(s), "track_id")
    per_album = joined.groupBy("artist_id", "album_id").agg(
        F.sum("play_count").alias("play_count"),
        F.count(F.lit(1)).alias("track_count"),
        F.min("first_played").alias("first_played"),
        F.max("last_played").alias("last_played"),
    )
    agg = per_album.groupBy("artist_id").agg(
        F.sum("play_count").alias("play_count"),
        F.sum("track_count").alias("track_count"),
        F.count(F.lit(1)).alias("album_count"),
        F.min("first_played").alias("first_played"),
        F.max("last_played").alias("last_played"),
    )
    names = s.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name"))
    return agg.join(names, "artist_id")


def artists_with_stats(
    s: Snowflake,
    limit: int = 50,
    sort_by: str = "plays",
    order: str = "desc",
    min_plays: int = 0,
    since=None,
    until=None,
) -> DataFrame:
    """Q5: artists with stats, HAVING ``play_count >= min_plays``, sorted, top ``limit``.

    ``recent`` always sorts newest first (the reference ignores ``order`` there).
    Ties are broken by artist id.
    """
    desc = order.lower() != "asc"
    if sort_by == "plays":
        key = F.col("play_count").desc() if desc else F.col("play_count").asc()
    elif sort_by == "name":
        key = F.col("artist_name").desc() if desc else F.col("artist_name").asc()
    elif sort_by == "recent":
        key = F.col("last_played").desc()
    else:
        raise ValueError(f"Unknown sort_by: {sort_by}")
    stats = artist_rollup(s, since, until).filter(F.col("play_count") >= F.lit(min_plays))
    cols = ["artist_id", "artist_name", "play_count", "track_count", "album_count", "last_played"]
    return top_k(stats.select(*cols), [key, F.col("artist_id")], limit)


# ---------------------------------------------------------------- Q10/Q11 top-N
def _ranked(limit: int) -> int:
    """A ranked list has a length: its rows are numbered in one task."""
    if limit is None or limit < 1:
        raise ValueError("limit must be a positive integer")
    return int(limit)


def _days_in_range(plays_in_range: DataFrame, since, until, as_of) -> "F.Column":
    """The day count behind ``avg_plays_per_day`` (whole days, 0 -> 1)."""

    def whole_days(a, b):
        return (b - a).days or 1

    if since is not None and until is not None:
        return F.lit(whole_days(_as_dt(since), _as_dt(until))).cast("long")
    if since is not None:
        now = _as_dt(as_of) if as_of is not None else dt.datetime.now(dt.UTC).replace(tzinfo=None)
        return F.lit(whole_days(_as_dt(since), now)).cast("long")
    if until is not None:
        # Decision D7: first play in range -> until (never negative, at least 1).
        first = plays_in_range.select(F.min("timestamp")).scalar()
        secs = F.unix_seconds(F.lit(until).cast("timestamp")) - F.unix_seconds(first)
    else:
        first = plays_in_range.select(F.min("timestamp")).scalar()
        last = plays_in_range.select(F.max("timestamp")).scalar()
        secs = F.unix_seconds(last) - F.unix_seconds(first)
    days = F.floor(secs / F.lit(86400))
    return F.when(days.isNull() | (days <= 0), F.lit(1)).otherwise(days).cast("long")


def _as_dt(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None) if value.tzinfo is None else value.astimezone(
            dt.UTC
        ).replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def top_artists(
    s: Snowflake, limit: int = 10, since=None, until=None, as_of=None
) -> DataFrame:
    """Q10: rank, plays, share of *all* plays in range, mean plays per day."""
    plays = time_range(s.plays, since, until)
    total = plays.select(F.count(F.lit(1))).scalar()
    per_track = plays.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    per_artist = (
        per_track.join(joined_track_keys(s), "track_id")
        .groupBy("artist_id")
        .agg(F.sum("n").alias("play_count"))
        .join(s.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name")), "artist_id")
    )
    order = [F.col("play_count").desc(), F.col("artist_id")]
    best = top_k(per_artist, order, _ranked(limit))
    days = _days_in_range(plays, since, until, as_of)
    return with_rank(best, order).select(
        "rank",
        "artist_id",
        "artist_name",
        "play_count",
        _round6(F.when(total > 0, F.col("play_count") / total * 100).otherwise(F.lit(0.0))).alias(
            "percentage"
        ),
        _round6(F.col("play_count") / days).alias("avg_plays_per_day"),
    )


def top_tracks(
    s: Snowflake, limit: int = 10, since=None, until=None, artist: str | None = None
) -> DataFrame:
    """Q11: rank, names, plays, share of the *joined and filtered* plays."""
    from encore.functions.text import contains_ci

    per_track = time_range(s.plays, since, until).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("play_count")
    )
    dims = track_dims(s)
    if artist:
        dims = dims.filter(contains_ci("artist_name", artist))
    joined = per_track.join(dims, "track_id")
    total = joined.select(F.sum("play_count")).scalar()
    order = [F.col("play_count").desc(), F.col("track_id")]
    best = top_k(joined, order, _ranked(limit))
    return with_rank(best, order).select(
        "rank",
        "track_id",
        "track_title",
        "artist_name",
        "album_title",
        "play_count",
        _round6(
            F.when(total > 0, F.col("play_count") / total * 100).otherwise(F.lit(0.0))
        ).alias("percentage"),
    )


# ---------------------------------------------------------------- Q37 monthly rate
def track_monthly_rate(s: Snowflake) -> DataFrame:
    """Q37: for every track, plays per calendar month between first and last play.

    ``n / (12*(y2-y1) + (m2-m1))`` with 0 months counted as 1; null when the
    track was never played.
    """
    stats = track_play_stats(s.plays)
    tracks = s.tracks.select(F.col("id").alias("track_id"), F.col("title").alias("track_title"))
    joined = tracks.join(stats, "track_id", "left")
    months = (F.year("last_played") - F.year("first_played")) * 12 + (
        F.month("last_played") - F.month("first_played")
    )
    months = F.when(months == 0, F.lit(1)).otherwise(months)
    return joined.select(
        "track_id",
        "track_title",
        F.coalesce(F.col("play_count"), F.lit(0)).alias("play_count"),
        "first_played",
        "last_played",
        _round6(F.col("play_count") / months).alias("avg_plays_per_month"),
    )


# ---------------------------------------------------------------- Q38 play gaps
def play_gaps(s: Snowflake, newest: int | None = None) -> DataFrame:
    """Q38: per track, newest first, whole days since the next newer play.

    A lag over one window per track would put a hot track (say a third of all
    plays) into one task. Instead the lag runs per ``(track, day)`` bucket and
    the first row of each bucket takes the oldest play of the nearest newer
    bucket, found by a second lag over the small per-bucket summary.
    ``newest`` keeps only each track's newest plays (the show command uses 100).
    """
    plays = s.plays.select("track_id", "timestamp").filter(F.col("timestamp").isNotNull())
    if newest is not None:
        plays = top_k_per_group(
            plays, ["track_id"], [F.col("timestamp").desc()], newest, split_by=["timestamp"]
        )
    plays = plays.withColumn("_bucket", F.date_trunc("day", "timestamp"))
    in_bucket = Window.partitionBy("track_id", "_bucket").orderBy(F.col("timestamp").desc())
    plays = plays.withColumn("_newer", F.lag("timestamp").over(in_bucket))
    buckets = plays.groupBy("track_id", "_bucket").agg(F.min("timestamp").alias("_oldest"))
    across = Window.partitionBy("track_id").orderBy(F.col("_bucket").desc())
    buckets = buckets.select(
        "track_id", "_bucket", F.lag("_oldest").over(across).alias("_next_bucket_oldest")
    )
    joined = plays.join(buckets, ["track_id", "_bucket"])
    newer = F.coalesce(F.col("_newer"), F.col("_next_bucket_oldest"))
    gap = F.floor((F.unix_micros(newer) - F.unix_micros(F.col("timestamp"))) / F.lit(86400000000))
    return joined.select(
        "track_id",
        "timestamp",
        gap.cast("long").alias("gap_days"),
        F.when(gap > 0, gap.cast("long").cast("string"))
        .when(newer.isNotNull(), F.lit("<1"))
        .alias("gap_label"),
    )


# ---------------------------------------------------------------- F9/F10 time ranges
def range_counts(s: Snowflake, ranges: dict[str, tuple]) -> DataFrame:
    """Plays and distinct tracks in each named range (since, until; both ends included, None: open).

    The bounds are instants or columns. One pass counts the plays of each range per track, whatever the number
    of ranges; from these rows both figures follow, so no range is a distinct count of its own.
    """
    bound = lambda b: b if isinstance(b, Column) else F.lit(b).cast("timestamp")
    names, counts = list(ranges), []
    for i, (since, until) in enumerate(ranges.values()):
        held = F.col("timestamp").isNotNull()
        if since is not None:
            held = held & (F.col("timestamp") >= bound(since))
        if until is not None:
            held = held & (F.col("timestamp") <= bound(until))
        counts.append(F.count_if(held).alias(f"n{i}"))
    per_track = s.plays.groupBy("track_id").agg(*counts)
    figures = per_track.agg(
        F.array(*[
            F.struct(
                F.lit(name).alias("range"), F.coalesce(F.sum(f"n{i}"), F.lit(0)).cast("long").alias("plays"),
                F.count_if(F.col(f"n{i}") > 0).alias("tracks"),
            )
            for i, name in enumerate(names)
        ]).alias("r")
    )
    return figures.select(F.explode("r").alias("r")).select("r.*")
