"""Registered catalogue, drill-down and browse queries on binding A."""

from __future__ import annotations

from encore.operators import catalogue as cat
from encore.plans.registry import register
from encore.schema import Snowflake
from encore.sources.tables import BINDING_A_SQL as A
from encore.sources.tables import binding_a

ALBUM_LEFT = """FROM albums al
JOIN artists ar ON al.artist_id = ar.id
LEFT JOIN tracks t ON t.album_id = al.id
LEFT JOIN plays p ON p.track_id = t.id"""

TRACK_LEFT = """FROM tracks t
JOIN albums al ON t.album_id = al.id
JOIN artists ar ON al.artist_id = ar.id
LEFT JOIN plays p ON p.track_id = t.id"""


@register(
    "albums_search",
    A
    + f"""
SELECT al.id AS album_id, al.title AS album_title, ar.name AS artist_name,
       COUNT(DISTINCT t.id) AS track_count, COUNT(p."timestamp") AS play_count,
       MAX(p."timestamp") AS last_played
{ALBUM_LEFT}
WHERE al.title ILIKE '%nation_1%' ESCAPE '~'
GROUP BY al.id, al.title, ar.name
ORDER BY play_count DESC, album_title, album_id
LIMIT 20""",
)
def q_albums_search(spark, sf_dir):
    return cat.albums_search(binding_a(spark, sf_dir), "nation_1", limit=20)


@register(
    "tracks_search",
    A
    + f"""
SELECT t.id AS track_id, t.title AS track_title, ar.name AS artist_name, al.title AS album_title,
       COUNT(p."timestamp") AS play_count, MAX(p."timestamp") AS last_played
{TRACK_LEFT}
WHERE t.title ILIKE '%0001%' ESCAPE '~' AND ar.name ILIKE '%asia%' ESCAPE '~'
GROUP BY t.id, t.title, ar.name, al.title
ORDER BY play_count DESC, track_title, track_id
LIMIT 20""",
)
def q_tracks_search(spark, sf_dir):
    return cat.tracks_search(binding_a(spark, sf_dir), "0001", artist="asia", limit=20)


@register(
    "albums_list",
    A
    + f"""
SELECT al.id AS album_id, al.title AS album_title, ar.name AS artist_name,
       COUNT(DISTINCT t.id) AS track_count, COUNT(p."timestamp") AS play_count,
       MAX(p."timestamp") AS last_played
{ALBUM_LEFT}
GROUP BY al.id, al.title, ar.name
HAVING COUNT(p."timestamp") >= 580
ORDER BY last_played DESC NULLS LAST, album_id
LIMIT 50""",
)
def q_albums_list(spark, sf_dir):
    return cat.albums_list(binding_a(spark, sf_dir), sort="recent", order="desc", min_plays=580)


@register(
    "artist_details",
    A
    + """
, st AS (SELECT al.artist_id, COUNT(*) AS play_count, COUNT(DISTINCT t.id) AS track_count,
                COUNT(DISTINCT al.id) AS album_count, MIN(p."timestamp") AS first_played,
                MAX(p."timestamp") AS last_played
         FROM plays p JOIN tracks t ON p.track_id = t.id JOIN albums al ON t.album_id = al.id
         GROUP BY al.artist_id)
SELECT ar.id AS artist_id, ar.name AS artist_name, COALESCE(play_count, 0) AS play_count,
       COALESCE(track_count, 0) AS track_count, COALESCE(album_count, 0) AS album_count,
       first_played, last_played
FROM artists ar LEFT JOIN st ON st.artist_id = ar.id""",
)
def q_artist_details(spark, sf_dir):
    return cat.artist_details_all(binding_a(spark, sf_dir))


ARTIST_TOP_SQL = """
, r AS (SELECT al.artist_id, t.id AS track_id, t.title AS track_title, al.title AS album_title,
               COUNT(*) AS play_count, MAX(p."timestamp") AS last_played
        FROM plays p JOIN tracks t ON p.track_id = t.id JOIN albums al ON t.album_id = al.id
        GROUP BY al.artist_id, t.id, t.title, al.title)
SELECT * FROM r
QUALIFY ROW_NUMBER() OVER (PARTITION BY artist_id ORDER BY play_count DESC, track_id) <= 10"""


@register("artist_top_tracks", A + ARTIST_TOP_SQL)
def q_artist_top_tracks(spark, sf_dir):
    return cat.artist_top_tracks_all(binding_a(spark, sf_dir), 10)


ARTIST_ALBUMS_SQL = """
SELECT al.artist_id, al.id AS album_id, al.title AS album_title,
       COUNT(DISTINCT t.id) AS track_count, COUNT(p."timestamp") AS play_count,
       MAX(p."timestamp") AS last_played
FROM albums al LEFT JOIN tracks t ON t.album_id = al.id LEFT JOIN plays p ON p.track_id = t.id
GROUP BY al.artist_id, al.id, al.title"""


@register("artist_albums", A + ARTIST_ALBUMS_SQL)
def q_artist_albums(spark, sf_dir):
    return cat.artist_albums_all(binding_a(spark, sf_dir))


@register(
    "album_details",
    A
    + f"""
SELECT al.id AS album_id, al.title AS album_title, ar.name AS artist_name,
       COUNT(DISTINCT t.id) AS track_count, COUNT(p."timestamp") AS play_count,
       MIN(p."timestamp") AS first_played, MAX(p."timestamp") AS last_played
{ALBUM_LEFT}
GROUP BY al.id, al.title, ar.name""",
)
def q_album_details(spark, sf_dir):
    return cat.album_details_all(binding_a(spark, sf_dir))


@register(
    "album_tracks",
    A
    + """
SELECT t.album_id, t.id AS track_id, t.title AS track_title,
       COUNT(p."timestamp") AS play_count, MAX(p."timestamp") AS last_played
FROM tracks t LEFT JOIN plays p ON p.track_id = t.id
GROUP BY t.album_id, t.id, t.title""",
)
def q_album_tracks(spark, sf_dir):
    return cat.album_tracks_all(binding_a(spark, sf_dir))


@register(
    "track_details",
    A
    + f"""
SELECT t.id AS track_id, t.title AS track_title, ar.name AS artist_name, al.title AS album_title,
       COUNT(p.track_id) AS play_count, MIN(p."timestamp") AS first_played,
       MAX(p."timestamp") AS last_played
{TRACK_LEFT}
GROUP BY t.id, t.title, ar.name, al.title""",
)
def q_track_details(spark, sf_dir):
    return cat.track_details_all(binding_a(spark, sf_dir))


@register(
    "track_plays",
    A + 'SELECT track_id, "timestamp" FROM plays',
)
def q_track_plays(spark, sf_dir):
    return cat.track_plays_all(binding_a(spark, sf_dir))


@register(
    "track_plays_newest",
    A
    + """
SELECT track_id, "timestamp" FROM plays
QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY "timestamp" DESC) <= 5""",
)
def q_track_plays_newest(spark, sf_dir):
    return cat.track_plays_all(binding_a(spark, sf_dir), newest=5)


@register(
    "album_show",
    A
    + """
, per AS (SELECT t.id AS track_id, t.title AS track_title, t.album_id, COUNT(p."timestamp") AS play_count,
                 MAX(p."timestamp") AS last_played
          FROM tracks t LEFT JOIN plays p ON p.track_id = t.id GROUP BY t.id, t.title, t.album_id)
SELECT per.album_id, al.title AS album_title,
       CAST(SUM(play_count) OVER (PARTITION BY per.album_id) AS BIGINT) AS album_plays,
       CAST(ROW_NUMBER() OVER (PARTITION BY per.album_id ORDER BY track_id) - 1 AS INTEGER) AS position,
       track_id, track_title, play_count, last_played
FROM per JOIN albums al ON per.album_id = al.id""",
)
def q_album_show(spark, sf_dir):
    """The documents of all albums, a row a track."""
    return cat.album_show_rows(binding_a(spark, sf_dir))


@register(
    "track_show",
    A
    + """
SELECT t.id AS track_id, t.title AS track_title, COUNT(*) OVER (PARTITION BY t.id) AS play_count, p."timestamp" AS played_at
FROM plays p JOIN tracks t ON p.track_id = t.id
QUALIFY ROW_NUMBER() OVER (PARTITION BY t.id ORDER BY p."timestamp" DESC) <= 5""",
)
def q_track_show(spark, sf_dir):
    """The nested documents with their 5 newest plays, exploded for comparison."""
    from pyspark.sql import functions as F

    docs = cat.track_show(binding_a(spark, sf_dir), newest=5)
    return docs.select("track_id", "track_title", "play_count", F.explode("plays").alias("played_at"))


# Bindings whose plays start late leave tracks unplayed: zero counts, null times and their placement.
LATE = "1998-01-01"
A_LATE = A.replace("FROM orders)", f"FROM orders WHERE o_orderdate >= TIMESTAMP '{LATE} 00:00:00')")


def _played_since(s, since):
    from pyspark.sql import functions as F

    return Snowflake(s.artists, s.albums, s.tracks, s.plays.filter(F.col("timestamp") >= F.lit(since).cast("timestamp")))


def _late_page(sort: str, order: str):
    name = f"browse_unplayed_{sort.rsplit('_', 1)[1]}"

    @register(
        name,
        A_LATE
        + f"""
SELECT ar.name AS artist_name, al.title AS album_title, t.title AS track_title,
       COUNT(p."timestamp") AS play_count, MAX(p."timestamp") AS last_played,
       t.id AS track_id, al.id AS album_id, ar.id AS artist_id
{TRACK_LEFT}
GROUP BY t.id, al.id, ar.id, ar.name, al.title, t.title
ORDER BY {order}, t.id LIMIT 700""",
    )
    def q(spark, sf_dir):
        s = _played_since(binding_a(spark, sf_dir), LATE)
        return cat.browse_tracks(s, limit=700, sort_by=sort)

    return q


_late_page("last_played_desc", "last_played DESC NULLS LAST")
_late_page("last_played_asc", "last_played ASC NULLS FIRST")


@register(
    "album_fields",
    A
    + """
SELECT COUNT(p."timestamp") AS play_count, al.title AS album_title
FROM albums al JOIN artists ar ON al.artist_id = ar.id LEFT JOIN tracks t ON t.album_id = al.id
LEFT JOIN plays p ON p.track_id = t.id GROUP BY al.id, al.title""",
)
def q_album_fields(spark, sf_dir):
    """Two fields by their aliases, an unknown one dropped."""
    from encore.operators.output import ALBUM_FIELDS, select_fields

    return select_fields(cat.album_details_all(binding_a(spark, sf_dir)), ["plays", "no_such_field", "album"], ALBUM_FIELDS)


@register(
    "browse_tracks",
    A
    + f"""
SELECT ar.name AS artist_name, al.title AS album_title, t.title AS track_title,
       COUNT(p."timestamp") AS play_count, MAX(p."timestamp") AS last_played,
       t.id AS track_id, al.id AS album_id, ar.id AS artist_id
{TRACK_LEFT}
WHERE al.title ILIKE '%nation_2%' ESCAPE '~'
GROUP BY t.id, al.id, ar.id, ar.name, al.title, t.title
ORDER BY last_played DESC NULLS LAST, track_id
LIMIT 50 OFFSET 50""",
)
def q_browse_tracks(spark, sf_dir):
    return cat.browse_tracks(
        binding_a(spark, sf_dir),
        offset=50,
        limit=50,
        filter_text="nation_2",
        filter_column="album",
        sort_by="last_played_desc",
    )


# Pages of 3 tracks: the first, the 500th, and the last.
PAGE = 3


@register(
    "browse_pages",
    A
    + f"""
, rows AS (SELECT COUNT(p."timestamp") AS play_count, t.id AS track_id, t.title AS track_title
{TRACK_LEFT}
GROUP BY t.id, t.title),
placed AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY play_count DESC, track_id) - 1) // {PAGE} + 1 AS page,
                  (SELECT COUNT(*) FROM rows) AS n FROM rows)
SELECT CAST(page AS INTEGER) AS page, track_id, track_title, play_count FROM placed
WHERE page IN (1, 500, (n + {PAGE - 1}) // {PAGE})""",
)
def q_browse_pages(spark, sf_dir):
    """L3: deep pages, each found by counts between sampled keys; no task sorts more than 100 rows."""
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    s = binding_a(spark, sf_dir)
    total = cat.browse_total(s).first().total
    parts = [
        cat.browse_tracks(s, (page - 1) * PAGE, PAGE, range_rows=100).select(F.lit(page).alias("page"), "track_id", "track_title", "play_count")
        for page in sorted({1, 500, -(-total // PAGE)})
    ]
    return reduce(DataFrame.unionByName, parts)


@register(
    "browse_total",
    A
    + """
SELECT COUNT(DISTINCT t.id) AS total
FROM tracks t JOIN albums al ON t.album_id = al.id JOIN artists ar ON al.artist_id = ar.id
WHERE ar.name ILIKE '%rope%' ESCAPE '~' OR al.title ILIKE '%rope%' ESCAPE '~'
   OR t.title ILIKE '%rope%' ESCAPE '~'""",
)
def q_browse_total(spark, sf_dir):
    return cat.browse_total(binding_a(spark, sf_dir), "rope", "all")


@register(
    "browse_artists",
    A
    + """
SELECT ar.id AS id, ar.name AS name, COUNT(DISTINCT t.id) AS track_count
FROM artists ar JOIN albums al ON ar.id = al.artist_id JOIN tracks t ON al.id = t.album_id
GROUP BY ar.id, ar.name
ORDER BY track_count DESC, id
LIMIT 100""",
)
def q_browse_artists(spark, sf_dir):
    return cat.browse_artists(binding_a(spark, sf_dir), limit=100)


@register(
    "browse_albums",
    A
    + """
SELECT al.id AS id, al.title AS title, ar.name AS artist_name, COUNT(DISTINCT t.id) AS track_count
FROM albums al JOIN artists ar ON al.artist_id = ar.id JOIN tracks t ON al.id = t.album_id
GROUP BY al.id, al.title, ar.name
ORDER BY track_count DESC, id
LIMIT 100""",
)
def q_browse_albums(spark, sf_dir):
    return cat.browse_albums(binding_a(spark, sf_dir), limit=100)


@register(
    "artist_show",
    A
    + f"""
, r AS (SELECT al.artist_id, t.id AS track_id, t.title AS track_title,
               COUNT(*) AS play_count, MAX(p."timestamp") AS last_played
        FROM plays p JOIN tracks t ON p.track_id = t.id JOIN albums al ON t.album_id = al.id
        GROUP BY al.artist_id, t.id, t.title),
tops AS (SELECT * FROM r
         QUALIFY ROW_NUMBER() OVER (PARTITION BY artist_id ORDER BY play_count DESC, track_id) <= 10),
items AS (SELECT artist_id, 'top_track' AS section, track_id AS item_id, track_title AS item_title,
                 play_count, last_played FROM tops
          UNION ALL
          SELECT artist_id, 'album', album_id, album_title, play_count, last_played
          FROM ({ARTIST_ALBUMS_SQL}))
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY artist_id, section
                                  ORDER BY play_count DESC, item_id) AS INTEGER) AS position
FROM items""",
)
def q_artist_show(spark, sf_dir):
    return cat.show_items(binding_a(spark, sf_dir), top=10)


@register(
    "album_match",
    A
    + f"""
SELECT al.id AS album_id, al.title AS album_title, ar.name AS artist_name,
       COUNT(DISTINCT t.id) AS track_count, COUNT(p."timestamp") AS play_count,
       MIN(p."timestamp") AS first_played, MAX(p."timestamp") AS last_played
{ALBUM_LEFT}
WHERE al.title ILIKE '%nation_17%'
GROUP BY al.id, al.title, ar.name""",
)
def q_album_match(spark, sf_dir):
    """The one album that part of a title names, in lower case."""
    return cat.album_details(binding_a(spark, sf_dir), album_title="nation_17")


@register(
    "missing_plays",
    A
    + """
SELECT al.id AS album_id, al.title AS album_title, ar.name AS artist_name, COUNT(t.id) AS track_count,
       CAST(0 AS BIGINT) AS play_count, CAST(NULL AS TIMESTAMP) AS first_played, CAST(NULL AS TIMESTAMP) AS last_played
FROM albums al JOIN artists ar ON al.artist_id = ar.id LEFT JOIN tracks t ON t.album_id = al.id
GROUP BY al.id, al.title, ar.name""",
)
def q_missing_plays(spark, sf_dir):
    """A store without a table of plays counts none."""
    import uuid

    from encore.operators.store import DIMENSIONS, SnowflakeStore
    from encore.session import scratch_path

    s = binding_a(spark, sf_dir)
    store = SnowflakeStore(spark, scratch_path(spark, "stores", uuid.uuid4().hex))
    for name in DIMENSIONS:
        store.upsert_dimension(name, s.table(name))
    return cat.album_details_all(store.read())
