"""Registered profile, catalogue, ad-hoc SQL and file queries (Q30-Q33, Q35)."""

from __future__ import annotations

from encore.operators import adhoc, profile
from encore.plans.registry import register
from encore.sources.tables import BINDING_A_SQL as A
from encore.sources.tables import binding_a


TABLES = {"artists": ["id", "name"], "albums": ["id", "title", "artist_id"], "tracks": ["id", "title", "album_id"], "plays": ["timestamp", "track_id"]}


def _each_column(text: str) -> str:
    """``text`` for every column (c, as text v) of every table (t), in a union."""
    return "\nUNION ALL\n".join(
        text.format(t=t, c=c, v=f'CAST("{c}" AS VARCHAR)') for t, columns in TABLES.items() for c in columns
    )


def _tables(spark, sf_dir):
    s = binding_a(spark, sf_dir)
    return {t: s.table(t) for t in TABLES}


PROFILE_SQL = A + _each_column(
    """SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS total_rows, COUNT(*) - COUNT("{c}") AS num_null,
       COUNT_IF({v} = '') AS num_blank, COUNT(DISTINCT "{c}") AS num_distinct FROM {t}"""
)


@register("analyze_tables", PROFILE_SQL)
def q_analyze_tables(spark, sf_dir):
    return profile.analyze_database(_tables(spark, sf_dir))


@register("saved_profile", PROFILE_SQL)
def q_saved_profile(spark, sf_dir):
    """The profile as a saved table, read again."""
    import uuid

    from encore.operators.store import save_table
    from encore.session import scratch_path

    path = scratch_path(spark, "saved", uuid.uuid4().hex)
    save_table(profile.analyze_database(_tables(spark, sf_dir)), path)
    return spark.read.parquet(path)


@register(
    "analyze_common",
    A
    + ", v AS ("
    + _each_column("SELECT '{t}' AS table_name, '{c}' AS column_name, {v} AS value FROM {t}")
    + """),
c AS (SELECT table_name, column_name, value, COUNT(*) AS count FROM v GROUP BY ALL),
m AS (SELECT table_name, column_name, 'most' AS kind,
             CAST(ROW_NUMBER() OVER (PARTITION BY table_name, column_name ORDER BY count DESC, value ASC NULLS FIRST) AS INTEGER) AS rank,
             value, count FROM c),
l AS (SELECT table_name, column_name, 'least' AS kind,
             CAST(ROW_NUMBER() OVER (PARTITION BY table_name, column_name ORDER BY count ASC, value ASC NULLS FIRST) AS INTEGER) AS rank,
             value, count FROM c)
SELECT * FROM m WHERE rank <= 10 UNION ALL SELECT * FROM l WHERE rank <= 10""",
)
def q_analyze_common(spark, sf_dir):
    return profile.common_database(_tables(spark, sf_dir), limit=10)


@register(
    "table_overview",
    A
    + """
SELECT 'artists' AS table_name, (SELECT COUNT(*) FROM artists) AS row_count, 'id, name' AS columns,
       'struct<id:string,name:string>' AS schema
UNION ALL SELECT 'albums', (SELECT COUNT(*) FROM albums), 'id, title, artist_id',
       'struct<id:string,title:string,artist_id:string>'
UNION ALL SELECT 'tracks', (SELECT COUNT(*) FROM tracks), 'id, title, album_id',
       'struct<id:string,title:string,album_id:string>'
UNION ALL SELECT 'plays', (SELECT COUNT(*) FROM plays), 'timestamp, track_id',
       'struct<timestamp:timestamp,track_id:string>'""",
)
def q_table_overview(spark, sf_dir):
    s = binding_a(spark, sf_dir)
    return profile.table_overview(
        {"artists": s.artists, "albums": s.albums, "tracks": s.tracks, "plays": s.plays}
    )


SQL_TEXT = """
SELECT ar.name AS artist_name, CAST(year(p.timestamp) AS INT) AS year, COUNT(*) AS plays
FROM plays p JOIN tracks t ON p.track_id = t.id JOIN albums al ON t.album_id = al.id
JOIN artists ar ON al.artist_id = ar.id
WHERE p.timestamp >= {since}
GROUP BY ar.name, year(p.timestamp)"""


@register("sql_query", A + SQL_TEXT.format(since="TIMESTAMP '1998-01-01'"))
def q_sql_query(spark, sf_dir):
    import datetime as dt

    adhoc.register_snowflake(binding_a(spark, sf_dir))
    return adhoc.sql_query(spark, SQL_TEXT.format(since=":since"), {"since": dt.datetime(1998, 1, 1)})


ATTACHED_SQL = """
SELECT ar.name AS artist_name, COUNT(*) AS plays, COUNT({late}.track_id) AS later
FROM plays p JOIN tracks t ON p.track_id = t.id JOIN albums al ON t.album_id = al.id JOIN artists ar ON al.artist_id = ar.id
LEFT JOIN (SELECT DISTINCT track_id FROM {late}) {late} ON {late}.track_id = p.track_id
GROUP BY ar.name"""


@register("attached_query", A + ", late_plays AS (SELECT * FROM plays WHERE \"timestamp\" >= TIMESTAMP '2001-06-01')" + ATTACHED_SQL.format(late="late_plays"))
def q_attached_query(spark, sf_dir):
    """One query over two roots, the second a stored history of late plays under its own prefix."""
    import uuid

    from encore.operators.store import SnowflakeStore
    from encore.schema import Snowflake
    from encore.session import scratch_path

    s = binding_a(spark, sf_dir)
    store = SnowflakeStore(spark, scratch_path(spark, "stores", uuid.uuid4().hex))
    store.commit(Snowflake(s.artists, s.albums, s.tracks, s.plays.filter("timestamp >= TIMESTAMP '2001-06-01'")))
    adhoc.register_snowflake(s)
    adhoc.attach(spark, "late", store.root)
    return adhoc.sql_query(spark, ATTACHED_SQL.format(late="late_plays"))


@register(
    "table_rows",
    A
    + """
SELECT title, id FROM tracks WHERE album_id = '7'
ORDER BY title DESC LIMIT 20 OFFSET 5""",
)
def q_table_rows(spark, sf_dir):
    adhoc.register_snowflake(binding_a(spark, sf_dir))
    return adhoc.table_rows(
        spark, "tracks", columns=["title", "id"], where="album_id = :a", order="title desc",
        limit=20, offset=5, params={"a": "7"},
    )


@register(
    "files_query",
    A
    + """
SELECT ar.name AS artist_name, COUNT(*) AS tracks
FROM tracks t JOIN albums al ON t.album_id = al.id JOIN artists ar ON al.artist_id = ar.id GROUP BY ar.name""",
)
def q_files_query(spark, sf_dir):
    """Q35 over files Spark derives from the driver tables: the track catalogue
    is exported as CSV to the shared scratch folder, then queried with SQL."""
    import uuid

    from encore.operators.export import export_tracks, write_output
    from encore.session import scratch_path

    path = scratch_path(spark, "files", f"catalogue-{uuid.uuid4().hex}.csv")
    write_output(export_tracks(binding_a(spark, sf_dir)), path, fmt="csv")
    return adhoc.files_query(
        spark,
        [path],
        "SELECT artist_name, COUNT(*) AS tracks FROM " + path.rsplit("/", 1)[-1].split(".")[0].replace("-", "_")
        + " GROUP BY artist_name",
    )


@register(
    "sql_arrays",
    A
    + """
SELECT '[' || to_json(t.id) || ',' || to_json(t.title) || ',' || CAST(COUNT(p."timestamp") AS VARCHAR) || ']' AS value
FROM tracks t LEFT JOIN plays p ON p.track_id = t.id GROUP BY t.id, t.title""",
)
def q_sql_arrays(spark, sf_dir):
    """A SQL result as JSON arrays, one a line."""
    from encore.operators.output import as_lines

    adhoc.register_snowflake(binding_a(spark, sf_dir))
    rows = adhoc.sql_query(
        spark,
        "SELECT t.id, t.title, COUNT(p.timestamp) AS plays FROM tracks t LEFT JOIN plays p ON p.track_id = t.id GROUP BY t.id, t.title",
    )
    return as_lines(rows, "arrays")


@register(
    "sql_function",
    A
    + """
SELECT regexp_extract(al.title, '[^_]*$') AS part, COUNT(*) AS tracks
FROM tracks t JOIN albums al ON t.album_id = al.id GROUP BY 1""",
)
def q_sql_function(spark, sf_dir):
    """A caller's Python function in SQL."""

    def last_part(title):
        return None if title is None else title.rsplit("_", 1)[-1]

    adhoc.register_snowflake(binding_a(spark, sf_dir))
    adhoc.register_functions(spark, {"last_part": last_part})
    # called once an album, before the tracks are joined
    return adhoc.sql_query(
        spark,
        "SELECT al.part, SUM(t.n) AS tracks FROM (SELECT id, last_part(title) AS part FROM albums) al "
        "JOIN (SELECT album_id, COUNT(*) AS n FROM tracks GROUP BY album_id) t ON t.album_id = al.id GROUP BY al.part",
    )


@register(
    "files_flatten",
    A
    + """
SELECT ar.name AS album_artist_name, COUNT(DISTINCT al.title) AS albums, COUNT(*) AS tracks
FROM tracks t JOIN albums al ON t.album_id = al.id JOIN artists ar ON al.artist_id = ar.id GROUP BY ar.name""",
)
def q_files_flatten(spark, sf_dir):
    """The track catalogue as nested JSON lines, queried by flattened column names."""
    import uuid

    from pyspark.sql import functions as F

    from encore.operators.export import export_tracks, write_output
    from encore.session import scratch_path

    path = scratch_path(spark, "files", f"nested_{uuid.uuid4().hex}.jsonl")
    artist = F.struct(F.col("artist_id").alias("id"), F.col("artist_name").alias("name"))
    album = F.struct(F.col("album_id").alias("id"), F.col("album_title").alias("title"), artist.alias("artist"))
    write_output(export_tracks(binding_a(spark, sf_dir)).select("id", "title", album.alias("album")), path, fmt="jsonl")
    name = path.rsplit("/", 1)[-1].removesuffix(".jsonl")
    return adhoc.files_query(
        spark, [path],
        f"SELECT album_artist_name, COUNT(DISTINCT album_title) AS albums, COUNT(*) AS tracks FROM {name} GROUP BY album_artist_name",
        flatten=True,
    )
