"""Registered export presets (Q24-Q27) and an export with columns + sampling."""

from __future__ import annotations

from encore.operators import export as ex
from encore.plans.registry import register
from encore.sources.tables import BINDING_A_SQL as A
from encore.sources.tables import binding_a


@register(
    "export_plays",
    A
    + """
SELECT p."timestamp", t.title AS track_title, al.title AS album_title, ar.name AS artist_name,
       t.id AS track_id, al.id AS album_id, ar.id AS artist_id
FROM plays p JOIN tracks t ON p.track_id = t.id JOIN albums al ON t.album_id = al.id
JOIN artists ar ON al.artist_id = ar.id
ORDER BY p."timestamp" DESC""",
)
def q_export_plays(spark, sf_dir):
    return ex.export_plays(binding_a(spark, sf_dir))


TRACKS_SQL = """
SELECT t.id, t.title, al.title AS album_title, ar.name AS artist_name, al.id AS album_id, ar.id AS artist_id
FROM tracks t JOIN albums al ON t.album_id = al.id JOIN artists ar ON al.artist_id = ar.id
ORDER BY ar.name, al.title, t.title"""


@register("export_tracks", A + TRACKS_SQL)
def q_export_tracks(spark, sf_dir):
    return ex.export_tracks(binding_a(spark, sf_dir))


@register(
    "export_albums",
    A
    + """
SELECT al.id, al.title, ar.name AS artist_name, ar.id AS artist_id, COUNT(DISTINCT t.id) AS track_count
FROM albums al JOIN artists ar ON al.artist_id = ar.id LEFT JOIN tracks t ON al.id = t.album_id
GROUP BY al.id, al.title, ar.name, ar.id
ORDER BY ar.name, al.title""",
)
def q_export_albums(spark, sf_dir):
    return ex.export_albums(binding_a(spark, sf_dir))


@register(
    "export_artists",
    A
    + """
SELECT ar.id, ar.name, COUNT(DISTINCT al.id) AS album_count, COUNT(DISTINCT t.id) AS track_count,
       COUNT(p."timestamp") AS play_count
FROM artists ar LEFT JOIN albums al ON ar.id = al.artist_id LEFT JOIN tracks t ON al.id = t.album_id
LEFT JOIN plays p ON t.id = p.track_id
GROUP BY ar.id, ar.name
ORDER BY ar.name""",
)
def q_export_artists(spark, sf_dir):
    return ex.export_artists(binding_a(spark, sf_dir))


@register(
    "export_sample",
    A
    + """
, x AS (SELECT t.id, t.title, ar.name AS artist_name
        FROM tracks t JOIN albums al ON t.album_id = al.id JOIN artists ar ON al.artist_id = ar.id)
SELECT * FROM x
WHERE ('0x' || substr(md5('3|' || to_json({'id': id, 'title': title, 'artist_name': artist_name})), 1, 8))::BIGINT
      < 1288490189""",
)
def q_export_sample(spark, sf_dir):
    return ex.export(binding_a(spark, sf_dir), "tracks", columns=["id", "title", "artist_name"], sample=0.3, seed=3)


@register("export_limited", A + "SELECT id, title FROM (" + TRACKS_SQL + " LIMIT 200)")
def q_export_limited(spark, sf_dir):
    """Named columns of the first rows in the preset's order."""
    return ex.export(binding_a(spark, sf_dir), "tracks", columns=["id", "title"], limit=200)
