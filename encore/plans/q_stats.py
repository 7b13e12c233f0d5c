"""Registered stats queries on binding A (Q1-Q5, Q10, Q11, Q28, Q37, Q38)."""

from __future__ import annotations

from encore.operators import stats
from encore.plans.registry import register
from encore.sources.tables import BINDING_A_SQL as A
from encore.sources.tables import binding_a

CHAIN = """FROM plays p
JOIN tracks t ON p.track_id = t.id
JOIN albums al ON t.album_id = al.id
JOIN artists ar ON al.artist_id = ar.id"""


@register(
    "overview_stats",
    A
    + """
SELECT (SELECT COUNT(*) FROM plays) AS total_scrobbles,
       (SELECT COUNT(*) FROM artists) AS unique_artists,
       (SELECT COUNT(*) FROM albums) AS unique_albums,
       (SELECT COUNT(*) FROM tracks) AS unique_tracks,
       (SELECT MIN("timestamp") FROM plays) AS first_scrobble,
       (SELECT MAX("timestamp") FROM plays) AS last_scrobble""",
)
def q_overview(spark, sf_dir):
    return stats.overview_stats(binding_a(spark, sf_dir))


MONTHLY_SQL = f"""
SELECT CAST(year(p."timestamp") AS INTEGER) AS year,
       CAST(month(p."timestamp") AS INTEGER) AS month,
       COUNT(*) AS scrobbles,
       COUNT(DISTINCT ar.id) AS unique_artists,
       COUNT(DISTINCT al.id) AS unique_albums,
       COUNT(DISTINCT t.id) AS unique_tracks
{CHAIN}
WHERE p."timestamp" >= TIMESTAMP '1996-01-01' AND p."timestamp" <= TIMESTAMP '2000-12-31 23:59:59'
GROUP BY 1, 2
ORDER BY year DESC, month DESC"""


@register("monthly_rollup", A + MONTHLY_SQL)
def q_monthly(spark, sf_dir):
    return stats.monthly_rollup(
        binding_a(spark, sf_dir), since="1996-01-01", until="2000-12-31 23:59:59"
    )


YEARLY_SQL = f"""
SELECT CAST(year(p."timestamp") AS INTEGER) AS year,
       COUNT(*) AS scrobbles,
       COUNT(DISTINCT ar.id) AS unique_artists,
       COUNT(DISTINCT al.id) AS unique_albums,
       COUNT(DISTINCT t.id) AS unique_tracks
{CHAIN}
GROUP BY 1
ORDER BY year DESC"""


@register("yearly_rollup", A + YEARLY_SQL)
def q_yearly(spark, sf_dir):
    return stats.yearly_rollup(binding_a(spark, sf_dir))


@register(
    "monthly_totals",
    A
    + f""", r AS ({MONTHLY_SQL.replace("ORDER BY year DESC, month DESC", "ORDER BY year DESC, month DESC LIMIT 12")})
SELECT year, month, scrobbles, unique_artists, unique_albums, unique_tracks,
       'month' AS row_kind, CAST(NULL AS BIGINT) AS group_count FROM r
UNION ALL
SELECT NULL, NULL, SUM(scrobbles), NULL, NULL, NULL, 'total', COUNT(*) FROM r HAVING COUNT(*) > 1""",
)
def q_monthly_totals(spark, sf_dir):
    return stats.monthly_totals(
        binding_a(spark, sf_dir), since="1996-01-01", until="2000-12-31 23:59:59", limit=12
    )


@register(
    "yearly_totals",
    A
    + f""", r AS ({YEARLY_SQL})
SELECT year, scrobbles, unique_artists, unique_albums, unique_tracks,
       'year' AS row_kind, CAST(NULL AS BIGINT) AS group_count FROM r
UNION ALL
SELECT NULL, SUM(scrobbles), NULL, NULL, NULL, 'total', COUNT(*) FROM r HAVING COUNT(*) > 1""",
)
def q_yearly_totals(spark, sf_dir):
    return stats.yearly_totals(binding_a(spark, sf_dir))


@register(
    "plays_filtered",
    A
    + f"""
SELECT p."timestamp", ar.name AS artist_name, t.title AS track_title, al.title AS album_title
{CHAIN}
WHERE p."timestamp" >= TIMESTAMP '1997-01-01'
  AND ar.name ILIKE '%america%' ESCAPE '~' AND al.title ILIKE '%nation_1%' ESCAPE '~'
ORDER BY p."timestamp" DESC, artist_name, album_title, track_title
LIMIT 20""",
)
def q_plays_filtered(spark, sf_dir):
    return stats.plays_filtered(
        binding_a(spark, sf_dir), limit=20, since="1997-01-01", artist="america", album="nation_1"
    )


@register(
    "artists_with_stats",
    A
    + f"""
SELECT ar.id AS artist_id, ar.name AS artist_name, COUNT(*) AS play_count,
       COUNT(DISTINCT t.id) AS track_count, COUNT(DISTINCT al.id) AS album_count,
       MAX(p."timestamp") AS last_played
{CHAIN}
WHERE p."timestamp" >= TIMESTAMP '1998-01-01'
GROUP BY ar.id, ar.name
HAVING COUNT(*) >= 100
ORDER BY play_count DESC, artist_id
LIMIT 50""",
)
def q_artists_with_stats(spark, sf_dir):
    return stats.artists_with_stats(
        binding_a(spark, sf_dir), limit=50, sort_by="plays", min_plays=100, since="1998-01-01"
    )


TOP_ARTISTS_SQL = f"""
, tot AS (SELECT COUNT(*) AS n FROM plays),
rng AS (SELECT MIN("timestamp") AS lo, MAX("timestamp") AS hi FROM plays),
days AS (SELECT CASE WHEN d IS NULL OR d <= 0 THEN 1 ELSE d END AS d FROM
         (SELECT CAST(floor((epoch(hi) - epoch(lo)) / 86400) AS BIGINT) AS d FROM rng)),
agg AS (SELECT ar.id AS artist_id, ar.name AS artist_name, COUNT(*) AS play_count
        {CHAIN} GROUP BY ar.id, ar.name ORDER BY play_count DESC, artist_id LIMIT 10)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY play_count DESC, artist_id) AS INTEGER) AS rank,
       artist_id, artist_name, play_count,
       round(CASE WHEN tot.n > 0 THEN play_count / tot.n * 100 ELSE 0 END, 6) AS percentage,
       round(play_count / days.d, 6) AS avg_plays_per_day
FROM agg, tot, days"""


@register("top_artists", A + TOP_ARTISTS_SQL)
def q_top_artists(spark, sf_dir):
    return stats.top_artists(binding_a(spark, sf_dir), limit=10)


@register(
    "top_tracks",
    A
    + f"""
, agg AS (SELECT t.id AS track_id, t.title AS track_title, ar.name AS artist_name,
                 al.title AS album_title, COUNT(*) AS play_count
          {CHAIN}
          WHERE p."timestamp" >= TIMESTAMP '1996-06-01' AND p."timestamp" <= TIMESTAMP '2000-06-01'
            AND ar.name ILIKE '%europe%' ESCAPE '~'
          GROUP BY t.id, t.title, ar.name, al.title),
tot AS (SELECT SUM(play_count) AS n FROM agg),
best AS (SELECT * FROM agg ORDER BY play_count DESC, track_id LIMIT 10)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY play_count DESC, track_id) AS INTEGER) AS rank,
       track_id, track_title, artist_name, album_title, play_count,
       round(CASE WHEN tot.n > 0 THEN play_count / tot.n * 100 ELSE 0 END, 6) AS percentage
FROM best, tot""",
)
def q_top_tracks(spark, sf_dir):
    return stats.top_tracks(
        binding_a(spark, sf_dir), limit=10, since="1996-06-01", until="2000-06-01", artist="europe"
    )


@register(
    "track_monthly_rate",
    A
    + """
, st AS (SELECT track_id, COUNT(*) AS n, MIN("timestamp") AS lo, MAX("timestamp") AS hi
         FROM plays GROUP BY track_id)
SELECT t.id AS track_id, t.title AS track_title, COALESCE(st.n, 0) AS play_count,
       st.lo AS first_played, st.hi AS last_played,
       round(st.n / CASE WHEN m = 0 THEN 1 ELSE m END, 6) AS avg_plays_per_month
FROM tracks t LEFT JOIN (SELECT *, (year(hi) - year(lo)) * 12 + (month(hi) - month(lo)) AS m FROM st) st
  ON st.track_id = t.id""",
)
def q_track_monthly_rate(spark, sf_dir):
    return stats.track_monthly_rate(binding_a(spark, sf_dir))


@register(
    "play_gaps",
    A
    + """
, g AS (SELECT track_id, "timestamp",
               LAG("timestamp") OVER (PARTITION BY track_id ORDER BY "timestamp" DESC) AS newer
        FROM plays WHERE "timestamp" IS NOT NULL)
SELECT track_id, "timestamp",
       CAST(floor((epoch_us(newer) - epoch_us("timestamp")) / 86400000000) AS BIGINT) AS gap_days,
       CASE WHEN newer IS NULL THEN NULL
            WHEN floor((epoch_us(newer) - epoch_us("timestamp")) / 86400000000) > 0
            THEN CAST(CAST(floor((epoch_us(newer) - epoch_us("timestamp")) / 86400000000) AS BIGINT) AS VARCHAR)
            ELSE '<1' END AS gap_label
FROM g""",
)
def q_play_gaps(spark, sf_dir):
    return stats.play_gaps(binding_a(spark, sf_dir))


# ---------------------------------------------------------------- time forms
# Phrases of the command line, and the same bounds in SQL.
PHRASES = {
    "today": "date_trunc('day', m)",
    "yesterday": "date_trunc('day', m) - INTERVAL 1 DAY",
    "5 days ago": "m - INTERVAL 5 DAY",
    "last week": "m - INTERVAL 7 DAY",
    "1 month ago": "m - INTERVAL 1 MONTH",
    "13 months ago": "m - INTERVAL 13 MONTH",
    "last year": "m - INTERVAL 12 MONTH",
    "3 years ago": "m - INTERVAL 36 MONTH",
}
PERIODS = {
    "week": "m - INTERVAL 7 DAY",
    "month": "m - INTERVAL 30 DAY",
    "quarter": "m - INTERVAL 90 DAY",
    "year": "m - INTERVAL 365 DAY",
    "all-time": "CAST(NULL AS TIMESTAMP)",
}


@register(
    "range_counts",
    A
    + """, x AS (SELECT MAX("timestamp") AS m FROM plays),
b AS ("""
    + " UNION ALL ".join(f"SELECT '{name}' AS range, {lo} AS lo FROM x" for name, lo in (PHRASES | PERIODS).items())
    + """)
SELECT b.range, COUNT(p.track_id) AS plays, COUNT(DISTINCT p.track_id) AS tracks
FROM b LEFT JOIN plays p ON b.lo IS NULL OR p."timestamp" >= b.lo GROUP BY b.range""",
)
def q_range_counts(spark, sf_dir):
    """relative times and periods back from the last play, all counted in one pass."""
    from pyspark.sql import functions as F

    from encore.functions.timefn import parse_period, relative_column

    s = binding_a(spark, sf_dir)
    last = s.plays.select(F.max("timestamp"))
    as_of = last.first()[0]
    ranges = {phrase: (relative_column(last.scalar(), phrase), None) for phrase in PHRASES}
    ranges |= {period: parse_period(period, as_of) for period in PERIODS}
    return stats.range_counts(s, ranges)


@register(
    "last_play_display",
    A
    + """, l AS (SELECT track_id, MAX("timestamp") AS ts FROM plays WHERE "timestamp" >= TIMESTAMP '2000-06-01' GROUP BY track_id)
SELECT t.id, strftime(l.ts, '%b') AS month, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS shown,
       COALESCE(strftime(l.ts, '%Y-%m-%d %H:%M'), '-') AS minute, CAST(floor(epoch(l.ts)) AS BIGINT) AS seconds, l.ts AS instant
FROM tracks t LEFT JOIN l ON l.track_id = t.id""",
)
def q_last_play_display(spark, sf_dir):
    """The last play of every track since mid 2000 in each of the display forms, missing ones too."""
    from pyspark.sql import functions as F

    from encore.functions.timefn import display_minute, display_timestamp, from_epoch_seconds, month_label, to_epoch_seconds

    s = binding_a(spark, sf_dir)
    recent = s.plays.filter(F.col("timestamp") >= F.lit("2000-06-01").cast("timestamp"))
    last = recent.groupBy(F.col("track_id").alias("id")).agg(F.max("timestamp").alias("ts"))
    seconds = to_epoch_seconds(F.col("ts"))
    return s.tracks.select("id").join(last, "id", "left").select(
        "id", month_label(F.month("ts")).alias("month"), display_timestamp(F.col("ts")).alias("shown"),
        display_minute(F.col("ts")).alias("minute"), seconds.alias("seconds"), from_epoch_seconds(seconds).alias("instant"),
    )
