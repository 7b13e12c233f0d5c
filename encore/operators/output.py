"""Field selection with aliases (P7) and the shapes of SQL results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The field names that lists accept, and the columns they stand for.
ARTIST_FIELDS = {
    "id": "artist_id",
    "artist": "artist_name",
    "albums": "album_count",
    "tracks": "track_count",
    "plays": "play_count",
    "last_played": "last_played",
}
ALBUM_FIELDS = {
    "id": "album_id",
    "album": "album_title",
    "artist": "artist_name",
    "tracks": "track_count",
    "plays": "play_count",
    "last_played": "last_played",
}
TRACK_FIELDS = {
    "id": "track_id",
    "track": "track_title",
    "artist": "artist_name",
    "album": "album_title",
    "plays": "play_count",
    "last_played": "last_played",
}


def select_fields(df: DataFrame, fields: list[str] | None, aliases: dict[str, str]) -> DataFrame:
    """The columns that ``fields`` stand for, in that order; unknown names are dropped, no fields mean all."""
    if not fields:
        return df
    wanted = [aliases[f] for f in fields if aliases.get(f) in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(wanted)])


def _as_json(name: str, parse: bool) -> Column:
    """A column's value as JSON text; with ``parse``, text that holds an object or array stands as it is."""
    c = F.col(f"`{name}`")
    cell = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    inner = F.substring(cell, F.lit(2), F.char_length(cell) - 2)
    if not parse:
        return inner
    return F.when(c.rlike(r"^\s*[\[{]") & F.try_parse_json(c).isNotNull(), c).otherwise(inner)


def as_lines(df: DataFrame, shape: str = "objects", json_cols: bool = False) -> DataFrame:
    """A result as text lines (column ``value``), as many tasks as the result has.

    ``objects``: one JSON object a row; ``arrays``: one JSON array a row; ``raw_lines``: the first
    column of each row; ``raw``: the first column of the first row. ``json_cols``: text columns that
    hold a JSON object or array are written as JSON, not as an escaped string.
    """
    if shape in ("raw", "raw_lines"):
        first = df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("value"))
        return first.limit(1) if shape == "raw" else first
    cells = [_as_json(name, json_cols and kind == "string") for name, kind in df.dtypes]
    if shape == "arrays":
        return df.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("value"))
    if shape == "objects":
        named = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), c) for n, c in zip(df.columns, cells, strict=True)]
        return df.select(F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}")).alias("value"))
    raise ValueError(f"Unknown shape: {shape}")
