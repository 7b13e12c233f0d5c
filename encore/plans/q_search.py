"""Registered full-text, fuzzy and table-search queries (Q9, Q19, Q34, Q36)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from encore.functions.fuzzy import misspelt_as
from encore.operators import textindex as ti
from encore.operators.segments import standing_index
from encore.plans.registry import register
from encore.schema import Snowflake
from encore.session import scratch_path, written
from encore.sources.tables import BINDING_A_SQL as A
from encore.sources.tables import binding_a, read_table

TOKEN_RE = r"'[\p{L}\p{N}]+'"


def _postings_sql(docs: str, cols: list[str]) -> str:
    parts = [
        f"SELECT doc_id, '{c}' AS col, unnest(regexp_extract_all(lower(strip_accents({c})), {TOKEN_RE})) AS token FROM {docs}"
        for c in cols
    ]
    return "\nUNION ALL\n".join(parts)


def _bm25_sql(docs: str, cols: list[str], terms: list[tuple[str, bool]]) -> str:
    """DuckDB text of the BM25 ranking of ``docs`` for ANDed (token, is_prefix) terms."""
    hits = "\nUNION ALL\n".join(
        f"SELECT doc_id, {i} AS term_id FROM post WHERE "
        + (f"starts_with(token, '{t}')" if p else f"token = '{t}'")
        for i, (t, p) in enumerate(terms)
    )
    return f"""
, post AS ({_postings_sql(docs, cols)}),
dl AS (SELECT doc_id, COUNT(*) AS dl FROM post GROUP BY doc_id),
corpus AS (SELECT (SELECT COUNT(*) FROM {docs}) AS n, (SELECT SUM(dl)::DOUBLE / COUNT(*) FROM dl) AS avgdl),
hits AS ({hits}),
tf AS (SELECT doc_id, term_id, COUNT(*) AS tf FROM hits GROUP BY doc_id, term_id),
dft AS (SELECT term_id, COUNT(*) AS n FROM tf GROUP BY term_id),
idf AS (SELECT term_id, CASE WHEN ln((corpus.n - dft.n + 0.5) / (dft.n + 0.5)) > 0
                             THEN ln((corpus.n - dft.n + 0.5) / (dft.n + 0.5)) ELSE 1e-6 END AS idf
        FROM dft, corpus),
scored AS (SELECT tf.doc_id,
                  -SUM(idf.idf * (tf.tf * 2.2) / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / corpus.avgdl))) AS rank
           FROM tf JOIN idf ON tf.term_id = idf.term_id JOIN dl ON dl.doc_id = tf.doc_id, corpus
           GROUP BY tf.doc_id HAVING COUNT(*) = {len(terms)})
"""


DOCS_SQL = """
, docs AS (SELECT t.id AS doc_id, ar.name AS artist_name, al.title AS album_title, t.title AS track_title,
                  ar.id AS artist_id, al.id AS album_id, t.id AS track_id
           FROM tracks t JOIN albums al ON t.album_id = al.id JOIN artists ar ON al.artist_id = ar.id)
"""


@register(
    "search_tracks",
    A
    + DOCS_SQL
    + _bm25_sql("docs", ti.TRACK_COLUMNS, [("europe", False), ("0000001", True)])
    + """
SELECT d.track_id, d.track_title, d.album_id, d.album_title, d.artist_id, d.artist_name,
       COUNT(p."timestamp") AS play_count, MAX(p."timestamp") AS last_played, round(s.rank, 6) AS rank
FROM scored s JOIN docs d ON d.doc_id = s.doc_id LEFT JOIN plays p ON p.track_id = d.track_id
GROUP BY d.track_id, d.track_title, d.album_id, d.album_title, d.artist_id, d.artist_name, s.rank
ORDER BY rank, play_count DESC, track_id""",
)
def q_search_tracks(spark, sf_dir):
    """On a standing index, made when the tables' files are new: the search reads its terms' postings only."""
    s = binding_a(spark, sf_dir)
    index = standing_index(spark, "tracks", [s.tracks, s.albums, s.artists], ti.TRACK_COLUMNS, lambda: ti.index_tracks(s))
    return ti.search_tracks(s, ti.all_of(ti.term("europe"), ti.term("0000001", prefix=True)), index=index)


@register(
    "index_postings",
    A + DOCS_SQL + f", post AS ({_postings_sql('docs', ti.TRACK_COLUMNS)}) SELECT col, token, COUNT(*) AS n FROM post GROUP BY col, token",
)
def q_index_postings(spark, sf_dir):
    """The stored postings, counted by column and token."""
    index = ti.index_tracks(binding_a(spark, sf_dir)).write(scratch_path(spark, "indexes", uuid.uuid4().hex))
    return index.postings.groupBy("col", "token").agg(F.count(F.lit(1)).alias("n"))


@register("index_refresh", A + """
, renamed AS (SELECT id, CASE WHEN id = '2' THEN 'Renamed Région' ELSE name END AS name FROM artists),
docs AS (SELECT t.id AS doc_id, ar.name AS artist_name, al.title AS album_title, t.title AS track_title
         FROM tracks t JOIN albums al ON t.album_id = al.id JOIN renamed ar ON al.artist_id = ar.id
         WHERE CAST(t.id AS INTEGER) % 10 <> 0)""" + f", post AS ({_postings_sql('docs', ti.TRACK_COLUMNS)}) SELECT col, token, COUNT(*) AS n FROM post GROUP BY col, token")
def q_index_refresh(spark, sf_dir):
    """T5: an artist renamed and tracks deleted; the changed documents are derived, only they are indexed anew."""
    s = binding_a(spark, sf_dir)
    old = ti.index_tracks(s).write(scratch_path(spark, "indexes", uuid.uuid4().hex))
    named = s.artists.withColumn("name", F.when(F.col("id") == "2", F.lit("Renamed Région")).otherwise(F.col("name")))
    new = Snowflake(named, s.albums, s.tracks.filter(F.col("id").cast("int") % 10 != 0), s.plays)
    fresh = ti.refresh_index(old, new)
    return fresh.postings.groupBy("col", "token").agg(F.count(F.lit(1)).alias("n"))


# (token, begins so) of each term; an OR of two ANDs, less a phrase
TREE_SQL = """
, post AS (SELECT doc_id, unnest(list_transform(toks, lambda x, i: {'token': x, 'pos': i}), recursive := true)
           FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS toks FROM d)),
has AS (SELECT doc_id, COUNT_IF(token = 'les') AS les, COUNT_IF(token = 'avec') AS avec, COUNT_IF(token = 'und') AS und,
               COUNT_IF(starts_with(token, 'heit')) AS heit FROM post GROUP BY doc_id),
phrase AS (SELECT DISTINCT a.doc_id FROM post a JOIN post b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
           WHERE a.token = 'la' AND b.token = 'de')
SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM has
WHERE ((les > 0 AND avec > 0) OR (und > 0 AND heit > 0)) AND doc_id NOT IN (SELECT doc_id FROM phrase)"""


@register("search_tree", "WITH d AS (SELECT doc_id, text FROM documents)" + TREE_SQL)
def q_search_tree(spark, sf_dir):
    """AND inside OR, a prefix, and a phrase excluded, on a stored index."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    index = ti.index_documents(docs, "doc_id", ["text"]).write(scratch_path(spark, "indexes", uuid.uuid4().hex))
    either = ti.any_of(
        ti.all_of(ti.term("les"), ti.term("avec")), ti.all_of(ti.term("und"), ti.term("heit", prefix=True))
    )
    return ti.search(index, ti.all_of(either, ti.Not(ti.term("la de")))).select("doc_id")


@register("index_count", A + DOCS_SQL + "SELECT COUNT(*) AS indexed FROM docs")
def q_index_count(spark, sf_dir):
    return ti.index_tracks(binding_a(spark, sf_dir)).count()


DOC_COLS = ["doc_id", "lang", "source", "n_chars", "text"]


@register(
    "table_search",
    "WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents)"
    + _bm25_sql("d", ["text"], [("les", False), ("mentre", True)])
    + """
SELECT doc.doc_id, doc.lang, doc.source, doc.n_chars, doc.text, round(s.rank, 6) AS rank
FROM scored s JOIN documents doc ON CAST(doc.doc_id AS VARCHAR) = s.doc_id
ORDER BY rank, s.doc_id
LIMIT 20""",
)
def q_table_search(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(*DOC_COLS)
    index = ti.index_documents(docs, "doc_id", ["text"]).write(scratch_path(spark, "indexes", uuid.uuid4().hex))
    query = ti.all_of(ti.term("les"), ti.term("mentre", prefix=True))
    return ti.table_search(docs, "doc_id", ["text"], query, limit=20, columns=DOC_COLS, index=index)


# Score of the lower-case query against the names of ``cands`` (id, name), by a plain table of common subsequences:
# each row of it from the one before, a character of the window at a time.
def _fuzzy_sql(query: str) -> str:
    return f"""
, pairs AS (SELECT id, '{query}' AS q, lower(name) AS x FROM cands JOIN artists USING (id)),
sided AS (SELECT id, q AS s, x AS l FROM pairs WHERE len(q) <= len(x) UNION ALL SELECT id, x, q FROM pairs WHERE len(x) <= len(q)),
spans AS (SELECT id, s, l, unnest(range(1 - len(s), len(l))) AS f FROM sided),
windows AS (SELECT DISTINCT id, s, substr(l, greatest(f, 0) + 1, least(len(l), f + len(s)) - greatest(f, 0)) AS w FROM spans),
steps AS (
  SELECT id, s, w, 0 AS j, [0 FOR k IN range(len(s))] AS row FROM windows
  UNION ALL
  SELECT id, s, w, j + 1,
         [list_max([greatest(row[k], CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END + CASE WHEN s[k:k] = w[j + 1:j + 1] THEN 1 ELSE 0 END)
                    FOR k IN range(1, i + 1)]) FOR i IN range(1, len(s) + 1)]
  FROM steps WHERE j < len(w)),
fuzzy AS (SELECT id, MAX(200.0 * row[len(s)] / (len(s) + len(w))) AS score FROM steps WHERE j = len(w) GROUP BY id)"""


_ARTIST_STATS_SQL = """
SELECT ar.id AS artist_id, ar.name AS artist_name, COUNT(DISTINCT al.id) AS album_count,
       COUNT(DISTINCT t.id) AS track_count, COUNT(p."timestamp") AS play_count, MAX(p."timestamp") AS last_played,
       round(fuzzy.score, 6) AS fuzzy_score
FROM artists ar JOIN fuzzy USING (id) LEFT JOIN albums al ON al.artist_id = ar.id LEFT JOIN tracks t ON t.album_id = al.id
LEFT JOIN plays p ON p.track_id = t.id
GROUP BY ar.id, ar.name, fuzzy.score
ORDER BY fuzzy_score DESC, play_count DESC, artist_id LIMIT 20"""

#: Names that begin so, by their words, or hold the query.
_CANDIDATES_SQL = """
, named AS (SELECT DISTINCT ar.id, ar.name FROM tracks t JOIN albums al ON t.album_id = al.id JOIN artists ar ON al.artist_id = ar.id),
tok AS (SELECT id, regexp_extract_all(lower(strip_accents(name)), '[\\p{{L}}\\p{{N}}]+') AS words FROM named),
close AS (SELECT id FROM tok WHERE {words}
          UNION SELECT id FROM artists WHERE name ILIKE '%{query}%' ESCAPE '~')"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _rounded(df):
    return df.withColumn("fuzzy_score", F.round("fuzzy_score", 6))


@register(
    "artists_search",
    _recursive(
        A
        + _CANDIDATES_SQL.format(
            words="list_contains(words, 'east') AND len(list_filter(words, lambda x: starts_with(x, 'mid'))) > 0", query="east mid"
        )
        + ", cands AS (SELECT id FROM close)"
        + _fuzzy_sql("east mid")
        + _ARTIST_STATS_SQL
    ),
)
def q_artists_search(spark, sf_dir):
    """Q9: words in another order than the name's, so that the score is below 100."""
    return _rounded(ti.artists_search(binding_a(spark, sf_dir), "east mid", limit=20))


# Parts by name: an artist is a part name, an album its brand, a track the part, played when it was shipped.
PARTS_SQL = """
WITH artists AS (SELECT DISTINCT p_name AS id, p_name AS name FROM part),
albums AS (SELECT DISTINCT p_name || '|' || p_brand AS id, p_brand AS title, p_name AS artist_id FROM part),
tracks AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS title, p_name || '|' || p_brand AS album_id FROM part),
plays AS (SELECT CAST(l_shipdate AS TIMESTAMP) AS "timestamp", CAST(l_partkey AS VARCHAR) AS track_id FROM lineitem)"""


def _parts(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    album = F.concat_ws("|", "p_name", "p_brand")
    return Snowflake(
        part.select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct(),
        part.select(album.alias("id"), F.col("p_brand").alias("title"), F.col("p_name").alias("artist_id")).distinct(),
        part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("title"), album.alias("album_id")),
        read_table(spark, sf_dir, "lineitem").select(
            F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.col("l_partkey").cast("string").alias("track_id")
        ),
    )


MISSPELT = "red wigdet"
_GRAMS, _LEAST = misspelt_as(MISSPELT)


@register(
    "artists_misspelt",
    _recursive(
        PARTS_SQL
        + _CANDIDATES_SQL.format(
            words="list_contains(words, 'red') AND len(list_filter(words, lambda x: starts_with(x, 'wigdet'))) > 0", query=MISSPELT
        )
        + f""", cands AS (SELECT id FROM close UNION
  SELECT id FROM artists WHERE len(list_filter([{", ".join(f"'{g}'" for g in _GRAMS)}], lambda g: contains(lower(name), g))) >= {_LEAST})"""
        + _fuzzy_sql(MISSPELT)
        + _ARTIST_STATS_SQL
    ),
)
def q_artists_misspelt(spark, sf_dir):
    """Z3: a misspelt query finds its names by the runs of three characters that they share, looked up in stored postings."""
    s = _parts(spark, sf_dir)
    postings = written(ti.trigram_postings(s.artists).repartitionByRange("gram", "id").sortWithinPartitions("gram"), "indexes")
    return _rounded(ti.artists_search(s, MISSPELT, limit=20, misspelt=True, postings=postings))


@register(
    "artist_candidates",
    A
    + """
, named AS (SELECT DISTINCT ar.id, ar.name FROM tracks t JOIN albums al ON t.album_id = al.id
            JOIN artists ar ON al.artist_id = ar.id),
fts AS (SELECT id FROM named
        WHERE len(list_filter(regexp_extract_all(lower(strip_accents(name)), '[\\p{L}\\p{N}]+'),
                              lambda x: starts_with(x, 'ame'))) > 0),
cands AS (SELECT id FROM fts UNION SELECT id FROM artists WHERE name ILIKE '%ame%' ESCAPE '~')
SELECT ar.id AS artist_id, ar.name AS artist_name, COUNT(DISTINCT al.id) AS album_count,
       COUNT(DISTINCT t.id) AS track_count, COUNT(p."timestamp") AS play_count,
       MAX(p."timestamp") AS last_played
FROM artists ar LEFT JOIN albums al ON al.artist_id = ar.id LEFT JOIN tracks t ON t.album_id = al.id
LEFT JOIN plays p ON p.track_id = t.id
WHERE ar.id IN (SELECT id FROM cands)
GROUP BY ar.id, ar.name""",
)
def q_artist_candidates(spark, sf_dir):
    return ti.artist_candidates(binding_a(spark, sf_dir), "ame")
