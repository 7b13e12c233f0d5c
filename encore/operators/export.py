"""Export presets, sampling/limit/columns, writers.

Presets are DataFrame builders; the export options are DataFrame steps
(``select`` for columns, ``limit`` always applied to the DataFrame, a limit of any size over
many tasks, sampling by a seeded content hash *after* the limit, as the reference does). Writers
use Spark's distributed sinks, for a JSON array too (one element a line).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.operators.catalogue import album_rollup
from encore.operators.joins import track_dims
from encore.operators.selection import Key, first_rows, in_order, keys_of
from encore.schema import Snowflake
from encore.session import scratch_path


def _plays(s: Snowflake) -> DataFrame:
    columns = ["timestamp", "track_title", "album_title", "artist_name", "track_id", "album_id", "artist_id"]
    return s.plays.join(track_dims(s), "track_id").select(*columns)


def _tracks(s: Snowflake) -> DataFrame:
    return track_dims(s).select(
        F.col("track_id").alias("id"), F.col("track_title").alias("title"), "album_title", "artist_name", "album_id", "artist_id"
    )


def _albums(s: Snowflake) -> DataFrame:
    al = s.albums.select(F.col("id"), F.col("title"), "artist_id")
    ar = s.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name"))
    per = s.tracks.groupBy(F.col("album_id").alias("id")).agg(F.count("id").alias("track_count"))
    return (
        al.join(ar, "artist_id")
        .join(per, "id", "left")
        .select("id", "title", "artist_name", "artist_id", F.coalesce("track_count", F.lit(0).cast("long")).alias("track_count"))
    )


def _artists(s: Snowflake) -> DataFrame:
    rolled = s.albums.select(F.col("id").alias("album_id"), "artist_id").join(album_rollup(s), "album_id", "left")
    per = rolled.groupBy(F.col("artist_id").alias("id")).agg(
        F.count("album_id").alias("album_count"),
        F.coalesce(F.sum("track_count"), F.lit(0).cast("long")).alias("track_count"),
        F.coalesce(F.sum("play_count"), F.lit(0).cast("long")).alias("play_count"),
    )
    zero = F.lit(0).cast("long")
    return (
        s.artists.join(per, "id", "left")
        .select(
            "id",
            "name",
            F.coalesce("album_count", zero).alias("album_count"),
            F.coalesce("track_count", zero).alias("track_count"),
            F.coalesce("play_count", zero).alias("play_count"),
        )
    )


# Rows of each preset, and their order; ids break ties.
PRESETS: dict[str, tuple[Callable[[Snowflake], DataFrame], Sequence[Key]]] = {
    "plays": (_plays, [Key("timestamp", descending=True), Key("track_id")]),
    "tracks": (_tracks, keys_of("artist_name", "album_title", "title", "id")),
    "albums": (_albums, keys_of("artist_name", "title", "id")),
    "artists": (_artists, keys_of("name", "id")),
}


def export_plays(s: Snowflake) -> DataFrame:
    """Q24: full denormalised history, newest first, with all ids."""
    return export(s, "plays")


def export_tracks(s: Snowflake) -> DataFrame:
    """Q25: track catalogue ordered by artist, album, title."""
    return export(s, "tracks")


def export_albums(s: Snowflake) -> DataFrame:
    """Q26: albums with their track count (0 kept), ordered by artist, title."""
    return export(s, "albums")


def export_artists(s: Snowflake) -> DataFrame:
    """Q27: artists with album/track/play counts (0 kept), ordered by name."""
    return export(s, "artists")


def sample_rows(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """P13 for export: keep a row iff a seeded hash of its values is below ``fraction``.

    The decision depends only on the row's content, so the same seed gives
    the same sample under any partitioning. A fraction of 0 would export nothing, and is refused.
    """
    if not (0.0 < fraction <= 1.0):
        raise ValueError(f"an export can sample a share above 0, up to 1, not {fraction}")
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed if seed is not None else 0)), content))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return df.filter(bucket < F.lit(int(round(fraction * 4294967296))))


def prepare_export(
    df: DataFrame,
    columns: list[str] | None = None,
    limit: int | None = None,
    sample: float | None = None,
    seed: int | None = None,
    keys: Sequence[Key] = (),
) -> DataFrame:
    """L7 limit to the first rows in the order of ``keys``, P9 columns, then P13 sample (sampling after the limit)."""
    if seed is not None and sample is None:
        raise ValueError("a seed is of use only with a share to sample")
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns to export: {', '.join(missing)}")
    if keys:
        df = in_order(df, keys) if limit is None else first_rows(df, keys, int(limit))
    elif limit is not None:
        df = df.limit(int(limit))
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    if sample is not None:
        df = sample_rows(df, sample, seed)
    return df


def export(s: Snowflake, preset: str, **opts) -> DataFrame:
    if preset not in PRESETS:
        raise ValueError(f"Unknown preset: {preset}")
    rows, keys = PRESETS[preset]
    return prepare_export(rows(s), keys=keys, **opts)


def _write_array(df: DataFrame, path: str) -> int:
    """One JSON array over all part files of ``path``, in order: an element a line, brackets and commas around.

    Rows are written out with their place first, so that "the first row" is the same for every
    task; the sort by place is distributed, and no row is gathered anywhere.
    """
    spark = df.sparkSession
    staged = scratch_path(spark, "exports", uuid.uuid4().hex)
    element = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(element.alias("value"), F.monotonically_increasing_id().alias("place")).write.parquet(staged)
    rows = spark.read.parquet(staged)
    count, first = rows.agg(F.count("*"), F.min("place")).first()
    comma = F.when(F.col("place") == F.lit(first), F.lit("")).otherwise(F.lit(","))
    lines = rows.select("place", F.concat(comma, "value").alias("value"))
    ends = spark.createDataFrame([(-1, "["), (2**63 - 1, "]")], "place long, value string")
    lines.unionByName(ends).orderBy("place").select("value").write.mode("overwrite").text(path)
    return int(count)


def write_output(df: DataFrame, path: str, fmt: str = "jsonl", no_headers: bool = False) -> int:
    """Write ``df`` to ``path`` in jsonl/json/csv/tsv; returns the row count.

    The count comes from an ``observe`` metric of the write itself (no second pass). ``json`` is one
    array document: the part files of ``path``, read in order.
    """
    from pyspark.sql import Observation

    if fmt == "json":
        return _write_array(df, path)
    obs = Observation("export")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if fmt == "jsonl":
        observed.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt in ("csv", "tsv"):
        observed.write.mode("overwrite").option("header", not no_headers).option(
            "sep", "," if fmt == "csv" else "\t"
        ).csv(path)
    else:
        raise ValueError(f"Unknown format: {fmt}")
    return int(obs.get.get("rows", 0))


def dry_run(df: DataFrame) -> str:
    """K9 for export: the plan that would run (``explain`` text), without running it."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()
