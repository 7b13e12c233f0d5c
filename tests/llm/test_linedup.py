"""Site-relative line dedup against DuckDB and by hand."""

import duckdb

from encore.llm import linedup

PAGES = [
    (k, f"https://{'www.' if k % 2 else ''}Site.example:80/p{k}", f"<p>Menu</p><p> own {k} </p><p>own {k}</p><br>{'Ad' if k % 3 == 0 else ''}\nfoot<script>x</script>")
    for k in range(12)
] + [
    (20, "http://small.example/a", "<p>Menu</p>one"), (21, "http://small.example/b", "<p>Menu</p>two"), (22, None, "<p>x</p>"),
    (23, "http://Site.example/null", None), (24, "http://site.example/", ""), (20, "http://small.example/a", "<p>Menu</p>one"), (None, "junk", "<li>a<li>b"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'clash' AS host", "'clash' AS line", "'clash' AS n", "'clash' AS kept", "'clash' AS pages")


def test_against_sql(spark):
    got = linedup.dedup_lines(frame(spark, PAGES)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    want = con.sql(linedup.ORACLE_SQL).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    by = {r.page_id: r for r in got}
    assert by[1].text == "own 1\nown 1" and by[1].n_lines == 4
    assert by[20].text == "Menu\none" and by[23].text == "" and by[None].n_kept == 2


def test_a_line_counts_once_a_page(spark):
    rows = [(k, "http://h.example/", "<p>same<p>same<p>same" if k == 0 else f"<p>only {k}") for k in range(9)]
    assert {r.page_id: r.n_kept for r in linedup.dedup_lines(frame(spark, rows)).collect()}[0] == 3


def test_empty(spark):
    assert linedup.dedup_lines(frame(spark, []).limit(0)).collect() == []
