"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import bucket

#: What ends a line in a page: a line feed, or a tag that starts or ends a block.
BLOCK_TAG = r"(?i)</?(?:p|br|hr|li|ul|ol|div|nav|article|section|header|footer|aside|main|h[1-6]|tr|td|th|table|title|body|html|head|pre|blockquote)\b[^>]*>"
#: What is not text: scripts, styles, comments; then any other tag.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"

#: Parts that the pages of a host are dealt into where they meet its boilerplate.
SALTS = 32


def page_lines(html: Column) -> Column:
    """The trimmed lines of a page's text, without empty ones; null has none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), TAG, "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(lines, lambda x: x != "")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port or a leading `www.`; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, boilerplate): the lines on more than ``max_ratio`` of a host's pages, for hosts with any.

    ``pages`` has host and lines. A page counts a line once. Counts are pre-aggregated before
    they are shuffled, so a line on every page of a host costs a task one row. A host has at most
    (lines of a mean page) / max_ratio such lines, so the array is bounded by pages, not by hosts.
    """
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    common = counts.join(totals, "host").filter((F.col("pages") >= min_pages) & (F.col("n") > max_ratio * F.col("pages")))
    return common.groupBy("host").agg(F.collect_list("line").alias("boilerplate"))


def dedup_lines(
    pages: DataFrame, max_ratio: float = 0.3, min_pages: int = 5, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Each page's lines without its host's boilerplate.

    A line that stands on more than ``max_ratio`` of its host's pages is dropped wherever it
    stands on that host. Hosts of fewer than ``min_pages`` pages are left as they are: there, one
    page alone would make every line boilerplate. Pages whose URL has no host form one site.

    Returns page_id, host, n_lines, n_kept, text (kept lines joined by line feeds). Null html has
    no lines; repeated rows are pages of their own; other columns are ignored; an empty table
    gives an empty result.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), page_lines(F.col(html)).alias("lines"))
    common = boilerplate(rows.select("host", "lines"), max_ratio, min_pages)
    # a host may hold a third of all pages: these are dealt into parts, and the host's few lines go to each
    salted = rows.withColumn("part", bucket(SALTS, F.col("page_id"), F.col("lines")))
    common = common.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(common, ["host", "part"], "left").withColumn("boilerplate", F.coalesce("boilerplate", F.array().cast("array<string>")))
    kept = joined.withColumn("kept", F.filter("lines", lambda x: ~F.array_contains("boilerplate", x)))
    return kept.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"),
        F.array_join("kept", "\n").alias("text"),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, page_id,
    regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
        '(?i)</?(?:p|br|hr|li|ul|ol|div|nav|article|section|header|footer|aside|main|h[1-6]|tr|td|th|table|title|body|html|head|pre|blockquote)\b[^>]*>', chr(10), 'g'),
        '<[^>]*>', '', 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
lined AS (SELECT rid, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows),
totals AS (SELECT host, count(*) AS pages FROM rows GROUP BY host),
common AS (
  SELECT l.host, l.line FROM (SELECT host, line, count(DISTINCT rid) AS n FROM lined GROUP BY host, line) l
  JOIN totals t ON l.host = t.host WHERE t.pages >= 5 AND l.n > 0.3 * t.pages),
kept AS (
  SELECT l.rid, count(*) AS n_kept, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lined l
  WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.host = l.host AND c.line = l.line) GROUP BY l.rid)
SELECT r.page_id, r.host, CAST(len(r.lines) AS BIGINT) AS n_lines, CAST(coalesce(k.n_kept, 0) AS BIGINT) AS n_kept,
  coalesce(k.text, '') AS text
FROM rows r LEFT JOIN kept k ON r.rid = k.rid
"""
