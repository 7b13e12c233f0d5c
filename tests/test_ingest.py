"""FX5-FX7: record parsing, sources, loader statistics."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from encore.functions.records import UNREAD_TIME, parse_records
from encore.operators.ingest import LoadOptions, plan_load, records_from_columns
from encore.sources.files import detect_format, read_history_xml, read_jsonl, read_records


def parse_one(spark, fields: dict):
    df = spark.createDataFrame([(fields,)], "fields map<string,string>")
    return parse_records(df, freeform=True).first()


def test_record_and_ids(spark):
    r = parse_one(spark, {"timestamp": "2024-01-15T14:30:00", "artist": "The Beatles", "album": "Abbey Road",
                          "track": "Come Together"})
    assert r.reject_reason is None
    assert r.artist_id == "md5:c9e770c62114ed60fd1a4c6dd866e2d8"
    assert r.album_id.startswith("md5:") and r.track_id.startswith("md5:") and r.album_id != r.track_id
    no_album = parse_one(spark, {"timestamp": "2024-01-15", "artist": "X", "track": "Y"})
    assert no_album.album_title == "(unknown album)"
    alias = parse_one(spark, {"TIME": "2024-01-15", "Artist_Name": "The Beatles", "song": "Come Together"})
    assert (alias.artist_name, alias.track_title) == ("The Beatles", "Come Together")
    assert alias.artist_id == r.artist_id


@pytest.mark.parametrize("field", ["artist", "track", "timestamp"])
def test_missing_fields(spark, field):
    rec = {"timestamp": "2024-01-15", "artist": "A", "track": "T"}
    rec.pop(field)
    assert parse_one(spark, rec).reject_reason == f"{field} is missing"


# The accepted layouts and the instants they stand for.
def test_timestamps(spark):
    want = dt.datetime(2024, 1, 15, 14, 30)
    for text in ["1705329000", "2024-01-15T14:30:00", "2024-01-15 14:30:00", "2024/01/15 14:30:00",
                 "01/15/2024 14:30:00", "15/01/2024 14:30:00"]:
        assert parse_one(spark, {"timestamp": text, "artist": "a", "track": "t"}).timestamp == want, text
    assert parse_one(spark, {"timestamp": "2024-01-15", "artist": "a", "track": "t"}).timestamp == dt.datetime(2024, 1, 15)
    assert parse_one(spark, {"timestamp": "2024-01-15T14:30:00-05:00", "artist": "a", "track": "t"}).timestamp == dt.datetime(2024, 1, 15, 19, 30)
    assert parse_one(spark, {"timestamp": "20240115", "artist": "a", "track": "t"}).timestamp.year == 1970
    # milliseconds lie beyond the representable years
    assert parse_one(spark, {"timestamp": "1705329000000", "artist": "a", "track": "t"}).reject_reason.startswith(UNREAD_TIME)
    bad = parse_one(spark, {"timestamp": "not-a-date", "artist": "a", "track": "t"})
    assert bad.timestamp is None and bad.reject_reason.startswith(UNREAD_TIME)


def test_field_names_and_detection():
    assert detect_format('{"a": 1}') == "jsonl"
    assert detect_format("a,b,c") == "csv"
    assert detect_format("a\tb") == "tsv"
    assert detect_format("plain") == "jsonl"


def test_aliases(spark):
    row = parse_one(spark, {" Played_At ": "2024-01-15", "ArtistName": "a", "SONG": "t", "album_name": "b", "other": "x"})
    assert (row.artist_name, row.album_title, row.track_title, row.reject_reason) == ("a", "b", "t", None)


def test_sources(spark):
    d = tempfile.mkdtemp(prefix="encore-src-")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write('{"timestamp": "2024-01-15", "artist": "A", "track": "T"}\n\n[1]\n{bad\n')
    rows = read_jsonl(spark, os.path.join(d, "a.jsonl")).orderBy("_line").collect()
    assert [r._line for r in rows] == [1, 3, 4]
    assert rows[1].parse_error.startswith("Expected JSON object") and rows[2].parse_error == "Invalid JSON"
    plan = plan_load(read_jsonl(spark, os.path.join(d, "a.jsonl")), LoadOptions())
    with pytest.raises(ValueError, match="Line 3"):
        plan.check_errors()
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write('Track,ARTIST,time\n"Come, Together",The Beatles,2024-01-15\n')
    recs = read_records(spark, os.path.join(d, "b.csv"))
    r = parse_records(recs).first()
    assert (r.track_title, r.artist_name) == ("Come, Together", "The Beatles")
    with open(os.path.join(d, "p.xml"), "w") as f:
        f.write('<recenttracks><track><artist mbid="artist-123">Aretha Franklin</artist><name>Sisters</name>'
                '<mbid>track-123</mbid><album mbid="album-123"></album><date uts="1213031819">x</date></track></recenttracks>')
    x = parse_records(read_history_xml(spark, os.path.join(d, "p.xml")), id_mode="feed").first()
    assert x.album_title == "(unknown album)" and x.album_id == "album-123" and x.artist_id == "artist-123"
    assert x.timestamp == dt.datetime(2008, 6, 9, 17, 16, 59)


def series(spark, n, minute_key=True):
    rows = [(i, f"artist-{i}", f"album-{i}", f"track-{i}", f"2024-01-15T{14 + i // 60:02d}:{i % 60:02d}:00") for i in range(n)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string, t string")
    return records_from_columns(df, [None, None, "i"], {"timestamp": F.col("t"), "artist": F.col("a"),
                                                         "album": F.col("b"), "track": F.col("c")})


def test_loader_limit_sample_dedup(spark):
    s = plan_load(series(spark, 10), LoadOptions(limit=5)).summary().first()
    assert (s.added, s.total_processed, s.limit_reached) == (5, 6, True)
    a = plan_load(series(spark, 60), LoadOptions(sample=0.5, seed=42)).summary().first()
    assert 0 < a.sampled < 60 and a.added == a.sampled
    b = plan_load(series(spark, 60), LoadOptions(sample=0.5, seed=42)).summary().first()
    assert a.sampled == b.sampled
    c = plan_load(series(spark, 60), LoadOptions(sample=0.5, seed=42, limit=10)).summary().first()
    assert (c.added, c.limit_reached) == (10, True)
    first = plan_load(series(spark, 1), LoadOptions(no_duplicates=True))
    again = plan_load(series(spark, 1), LoadOptions(no_duplicates=True),
                      existing_plays=first.normalised().plays).summary().first()
    assert (again.added, again.skipped) == (0, 1)
    with pytest.raises(ValueError):
        LoadOptions(sample=1.5).validate()
    with pytest.raises(ValueError):
        LoadOptions(seed=1).validate()
