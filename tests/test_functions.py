"""F2-F4 display helpers, S6 expected count, R6 live rollup."""

import os
import tempfile

from pyspark.sql import functions as F

from encore.functions.timefn import display_minute, display_timestamp, month_label


def test_display(spark):
    df = spark.createDataFrame([(1, "2024-01-15T14:30:05", None), (12, "garbage", None), (13, "2024-02-01", None)],
                               "m int, t string, n timestamp")
    rows = df.select(month_label(F.col("m")).alias("l"), display_timestamp(F.col("t")).alias("d"),
                     display_minute(F.col("n")).alias("x")).collect()
    assert [r.l for r in rows] == ["Jan", "Dec", "13"]
    assert [r.d for r in rows] == ["2024-01-15 14:30:05", "garbage", "2024-02-01 00:00:00"]
    assert {r.x for r in rows} == {"-"}


def test_expected_count(spark):
    from encore.sources.files import read_jsonl
    from encore.streaming.ingest import expected_count

    d = tempfile.mkdtemp(prefix="encore-live-")
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.jsonl", "w") as f:
        for day in range(1, 6):
            f.write(f'{{"timestamp": "2024-01-0{day}T10:00:00", "artist": "A{day % 2}", "track": "T{day}"}}\n')
        f.write('{"timestamp": "2024-02-01T10:00:00", "artist": "A", "track": "T"}\n')
    recs = read_jsonl(spark, f"{d}/in/a.jsonl")
    assert expected_count(recs) == 6
    assert expected_count(recs, since="2024-01-03", until="2024-01-31") == 3


def test_relative_time(spark):
    import datetime as dt

    from encore.functions.timefn import from_epoch_seconds, parse_relative_time, relative_column, to_epoch_seconds

    now = dt.datetime(2024, 3, 31, 12, 30)
    want = {
        "today": dt.datetime(2024, 3, 31), "Yesterday": dt.datetime(2024, 3, 30), "last week": dt.datetime(2024, 3, 24, 12, 30),
        "1 month ago": dt.datetime(2024, 2, 29, 12, 30), "13 months ago": dt.datetime(2023, 2, 28, 12, 30),
        "2 years ago": dt.datetime(2022, 3, 31, 12, 30), "3 days ago": dt.datetime(2024, 3, 28, 12, 30),
    }
    df = spark.createDataFrame([(now,)], "t timestamp")
    for text, at in want.items():
        assert parse_relative_time(text, now) == at, text
        assert df.select(relative_column(F.col("t"), text).alias("r")).first().r == at, text
    assert parse_relative_time("2024-01-15", now) == dt.datetime(2024, 1, 15)
    assert parse_relative_time("no such time", now) is None
    assert df.select(from_epoch_seconds(to_epoch_seconds(F.col("t"))).alias("r")).first().r == now


def test_folding(spark):
    from encore.functions.tokenize import py_tokens, tokens

    text = "Vi\u1ec7t H\u00f6hner \u0391\u0301\u03c1\u03b7 e\u0301te\u0301 AC/DC"
    want = ["viet", "hohner", "\u03b1\u03c1\u03b7", "ete", "ac", "dc"]
    assert py_tokens(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("x")).first().x == want


def test_partial_ratio(spark):
    from encore.functions.fuzzy import partial_ratio, partial_ratio_column

    assert partial_ratio("abz", "axb") == partial_ratio("axb", "abz") == 80.0
    assert partial_ratio("", "") == 100.0 and partial_ratio("", "a") == 0.0
    pairs = [("beatles", "the beatles"), ("abz", "axb"), ("axb", "abz"), ("floyd", "pink flod"), ("", ""), ("x", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", partial_ratio_column(F.col("a"), F.col("b")).alias("s")).collect()}
    assert {k: v for k, v in got.items() if "" not in k} == {k: partial_ratio(*k) for k in pairs if "" not in k}
