"""Registered load-path queries on binding B.

Records are the denormalised line items (``l_shipdate``, ``p_brand``,
``p_type``, ``p_name``) shaped as import records; they go through the same
parse -> sample -> dedup -> normalise plan as files do.
"""

from __future__ import annotations

from encore.functions.records import UNREAD_TIME
from encore.operators.ingest import LoadOptions, dry_run, lineitem_records, plan_load
from encore.plans.registry import register

# DuckDB text of the record stream and the synthesised ids.
RECORDS_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS ts,
                  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ts_text,
                  p_brand, p_type, p_name,
                  trim(p_brand) AS artist, COALESCE(NULLIF(trim(p_type), ''), '(unknown album)') AS album,
                  trim(p_name) AS track
           FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT *, 'md5:' || md5(artist) AS artist_id FROM r),
b AS (SELECT *, 'md5:' || md5(artist_id || album) AS album_id FROM a),
recs AS (SELECT *, 'md5:' || md5(album_id || track) AS track_id FROM b)
"""

SAMPLED_SQL = (
    RECORDS_SQL
    + """, s AS (SELECT * FROM recs
      WHERE ('0x' || substr(md5('7|' || to_json(map(['timestamp', 'artist', 'album', 'track'],
                                                     [ts_text, p_brand, p_type, p_name]))), 1, 8))::BIGINT
            < 2147483648)
"""
)


def _load(spark, sf_dir, **opts):
    return plan_load(lineitem_records(spark, sf_dir), LoadOptions(no_duplicates=True, **opts))


@register("load_plays", RECORDS_SQL + 'SELECT DISTINCT ts AS "timestamp", track_id FROM recs')
def q_load_plays(spark, sf_dir):
    return _load(spark, sf_dir).normalised().plays


@register("load_artists", RECORDS_SQL + "SELECT DISTINCT artist_id AS id, artist AS name FROM recs")
def q_load_artists(spark, sf_dir):
    return _load(spark, sf_dir).normalised().artists


@register(
    "load_albums", RECORDS_SQL + "SELECT DISTINCT album_id AS id, album AS title, artist_id FROM recs"
)
def q_load_albums(spark, sf_dir):
    return _load(spark, sf_dir).normalised().albums


@register(
    "load_tracks", RECORDS_SQL + "SELECT DISTINCT track_id AS id, track AS title, album_id FROM recs"
)
def q_load_tracks(spark, sf_dir):
    return _load(spark, sf_dir).normalised().tracks


SUMMARY_SQL = (
    RECORDS_SQL
    + """
SELECT COUNT(*) AS total_processed, CAST(NULL AS BIGINT) AS sampled,
       (SELECT COUNT(*) FROM (SELECT DISTINCT ts, track_id FROM recs)) AS added,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT ts, track_id FROM recs)) AS skipped,
       CAST(0 AS BIGINT) AS errors, false AS limit_reached,
       MIN(ts) AS first_timestamp, MAX(ts) AS last_timestamp
FROM recs"""
)


@register("load_summary", SUMMARY_SQL)
def q_load_summary(spark, sf_dir):
    return _load(spark, sf_dir).summary()


@register("load_dry_run", SUMMARY_SQL)
def q_load_dry_run(spark, sf_dir):
    """K9: the same figures without a write."""
    return dry_run(lineitem_records(spark, sf_dir), LoadOptions(no_duplicates=True))


# Every third record is spoilt: no artist, an unreadable time, or milliseconds for seconds.
SPOILT_SQL = (
    RECORDS_SQL
    + """, s AS (SELECT *, l_orderkey % 9 AS k FROM recs)
SELECT CASE k WHEN 0 THEN 'artist is missing' ELSE 'unread time' END AS reason, COUNT(*) AS n
FROM s WHERE k IN (0, 3, 6) GROUP BY 1"""
)


@register("load_rejects", SPOILT_SQL)
def q_load_rejects(spark, sf_dir):
    """K8: rejects by reason, of records under other spellings of their fields."""
    from pyspark.sql import functions as F

    k = F.col("_block") % 9
    m = F.col("fields")
    time = F.when(k == 3, F.lit("no time")).when(k == 6, F.lit("1705329000000")).otherwise(m["timestamp"])
    artist = F.when(k != 0, m["artist"]).otherwise(F.lit(" "))
    named = F.create_map(
        F.lit(" Played_At "), time, F.lit("ARTIST_NAME"), artist, F.lit("albumtitle"), m["album"], F.lit("Song"), m["track"]
    )
    records = lineitem_records(spark, sf_dir).withColumn("fields", named)
    rejects = plan_load(records, LoadOptions(skip_errors=True)).rejects()
    reason = F.when(F.col("reason").startswith(UNREAD_TIME), "unread time").otherwise(F.col("reason"))
    return rejects.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "load_sample_summary",
    SAMPLED_SQL
    + """
SELECT (SELECT COUNT(*) FROM recs) AS total_processed, COUNT(*) AS sampled,
       (SELECT COUNT(*) FROM (SELECT DISTINCT ts, track_id FROM s)) AS added,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT ts, track_id FROM s)) AS skipped,
       CAST(0 AS BIGINT) AS errors, false AS limit_reached,
       MIN(ts) AS first_timestamp, MAX(ts) AS last_timestamp
FROM s""",
)
def q_load_sample_summary(spark, sf_dir):
    return _load(spark, sf_dir, sample=0.5, seed=7).summary()


@register("load_sample_plays", SAMPLED_SQL + 'SELECT DISTINCT ts AS "timestamp", track_id FROM s')
def q_load_sample_plays(spark, sf_dir):
    return _load(spark, sf_dir, sample=0.5, seed=7).normalised().plays
