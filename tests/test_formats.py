"""Record files of all formats, rejects with their place, limits over batches, bounded duplicate state, fuzzy names."""

import datetime as dt
import gzip
import os
import random

import pytest

from encore.functions import fuzzy
from encore.functions.records import parse_records
from encore.operators import textindex as ti
from encore.operators.ingest import LoadOptions, plan_load
from encore.operators.store import SnowflakeStore
from encore.schema import snowflake_from_rows
from encore.sources import fs
from encore.sources.files import format_of, read_delimited, read_records
from encore.streaming.ingest import start_ingest
from encore.streaming.unique import start_unique


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w")) as f:
        f.write(text)


CSV = 'Track,artist,time\n"a, b",A,2024-01-01\nx,A,2024-01-01,more\n"two\nlines",A,2024-01-02\nshort\n,A,2024-01-03\n"q""q",A,2024-01-06\n'


def test_delimited_rows(spark, tmp_path):
    put(f"{tmp_path}/a.csv", CSV)
    rows = {r._line: r for r in read_records(spark, f"{tmp_path}/a.csv").collect()}
    assert sorted(rows) == [2, 3, 4, 5, 6, 7]
    assert rows[2].fields == {"Track": "a, b", "artist": "A", "time": "2024-01-01"}
    assert rows[3].fields is None and rows[3].parse_error == "more cells than the header has"
    assert rows[4].fields["Track"] == "two\nlines" and rows[5].fields == {"Track": "short"} and rows[7].fields["Track"] == 'q"q'
    plan = plan_load(read_records(spark, f"{tmp_path}/a.csv"), LoadOptions(skip_errors=True))
    got = {r.line: r.reason for r in plan.rejects().collect()}
    assert got == {3: "more cells than the header has", 5: "timestamp is missing", 6: "track is missing"}
    assert all(r.file.endswith("a.csv") and r.content for r in plan.rejects().collect())
    assert plan.summary().first().added == 3
    with pytest.raises(ValueError, match="^Line 3: more cells"):
        plan_load(read_records(spark, f"{tmp_path}/a.csv")).check_errors()
    # read in pieces: as many records, numbered as they stand, where no cell holds a line break
    plain = "t,n\n" + "".join(f"x{k},{k}\n" for k in range(5000))
    put(f"{tmp_path}/b.csv", plain)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    split = read_delimited(spark, f"{tmp_path}/b.csv", multiline=False).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r._block for r in split}) > 1 and sorted((r._line, r.fields["n"]) for r in split) == [(k + 2, str(k)) for k in range(5000)]


def test_formats_are_told_apart(spark, tmp_path):
    files = {
        "a.csv": "timestamp\ttrack\tartist\n2024-01-01\tT1\tA\n",  # tabs, whatever the name says
        "b.txt": "artist,track,timestamp\nA,T2,2024-01-02\n",
        "c.csv": "track,timestamp,artist\nT3,2024-01-03,A\n",
        "d": '{"track": "T4", "timestamp": "2024-01-04", "artist": "A"}\n[1]\n',
        "e.csv.gz": "track,timestamp,artist\nT5,2024-01-05,A\n",
        "f.xml": '<r><track><artist>A</artist><name>T6</name><date uts="1704499200">x</date></track></r>',
        "g.dat": '<?xml version="1.0"?><r><track><artist>A</artist><name>T7</name><date uts="1704585600">x</date></track></r>',
    }
    for name, text in files.items():
        put(f"{tmp_path}/{name}", text)
    assert [format_of(spark, f) for f in fs.files_in(spark, str(tmp_path))] == ["tsv", "csv", "csv", "jsonl", "csv", "xml", "xml"]
    got = parse_records(read_records(spark, str(tmp_path)), keep=["parse_error"]).collect()
    assert sorted((r.track_title, r.timestamp) for r in got if r.parse_error is None) == [(f"T{k}", dt.datetime(2024, 1, k)) for k in range(1, 8)]
    assert [r.parse_error for r in got if r.parse_error] == ["Expected JSON object, got array"]
    with pytest.raises(ValueError, match="format"):
        read_records(spark, str(tmp_path), "parquet")


def test_stream_of_all_formats_and_replays(spark, tmp_path):
    put(f"{tmp_path}/in/a.csv", CSV)
    put(f"{tmp_path}/in/sub/b.jsonl", '{"track": "T", "timestamp": "2024-02-01", "artist": "A"}\n{bad\n{bad\n')
    put(f"{tmp_path}/in/c.xml", '<r><track><artist>A</artist><name>X</name><date uts="1704499200">x</date></track></r>')
    store = SnowflakeStore(spark, f"{tmp_path}/store")
    for n in range(2):  # the second through a checkpoint of its own: nothing is doubled
        start_ingest(spark, f"{tmp_path}/in", store.root, f"{tmp_path}/ck{n}").awaitTermination()
        assert store.read().plays.count() == 5
        assert sorted((r.file.rsplit("/", 1)[-1], r.line) for r in store.read_rejects().collect()) == [
            ("a.csv", 3), ("a.csv", 5), ("a.csv", 6), ("b.jsonl", 2), ("b.jsonl", 3)]
        assert len(store._log("artists", 0)) == 1


def test_limit_over_batches(spark, tmp_path):
    for n, days in enumerate(((1, 2, 2, 3), (3, 4, 5, 6), (7, 8))):
        put(f"{tmp_path}/in/{n}.jsonl", "".join(f'{{"timestamp": "2024-01-{d:02d}", "artist": "A", "track": "T"}}\n' for d in days))
        os.utime(f"{tmp_path}/in/{n}.jsonl", (1_700_000_000 + n, 1_700_000_000 + n))
    options = LoadOptions(skip_errors=True, no_duplicates=True, limit=5)
    for batches, name in ((1, "one"), (None, "all")):
        start_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/{name}", f"{tmp_path}/ck-{name}", options, max_files_per_trigger=batches).awaitTermination()
    days = lambda name: sorted(r.timestamp.day for r in SnowflakeStore(spark, f"{tmp_path}/{name}").read().plays.collect())
    assert days("one") == [1, 2, 3, 4]  # day 3 came twice, in two batches: five added, four plays
    assert days("all") == [1, 2, 3, 4, 5]


def test_bounded_duplicates(spark, tmp_path):
    run = lambda: start_unique(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", "2 days").awaitTermination()
    line = lambda d, t="T": f'{{"timestamp": "2024-01-{d:02d}", "artist": "A", "track": "{t}"}}\n'
    got = lambda: sorted((r.timestamp.day, r.track_title) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    put(f"{tmp_path}/in/a.jsonl", line(1) + line(1) + line(9) + line(10) + "{bad\n")
    run()
    assert got() == [(1, "T"), (9, "T"), (10, "T")]
    put(f"{tmp_path}/in/b.jsonl", line(9) + line(10) + line(9, "U") + line(1) + line(2) + line(11))
    run()  # started again from the checkpoint: 9 and 10 are known, 1 and 2 lie behind the watermark
    assert got() == [(1, "T"), (9, "T"), (9, "U"), (10, "T"), (11, "T")]


# ------------------------------------------------------------------ fuzzy
def plain_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for s, text in ((a, b), (b, a)):
        if len(s) <= len(text):
            for start in range(1 - len(s), len(text)):
                w = text[max(0, start) : start + len(s)]
                best = max(best, 200.0 * plain_lcs(s, w) / (len(s) + len(w)))
    return best


def test_machine_words_equal_the_table():
    rng = random.Random(1)
    for _ in range(1500):
        letters = "abcdefgh"[: rng.choice([2, 3, 8])]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(n))) for n in (12, 20))
        assert fuzzy.lcs(a, b) == plain_lcs(a, b)
        assert fuzzy.partial_ratio(a, b) == pytest.approx(plain_partial(a, b)), (a, b)
    long = "ab" * 100
    assert fuzzy.lcs(long, long[::-1]) == 199


def test_misspelt_names(spark):
    """Recall of the candidates against every name scored: 1 within the allowed edits, and what two edits more leave."""
    rng = random.Random(4)
    words = ["beatles", "rolling", "stones", "floyd", "purple", "velvet", "queen", "radio", "head", "arctic", "monkeys", "daft"]
    names = sorted({" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(300)})
    s = snowflake_from_rows(spark, [(str(k), n) for k, n in enumerate(names)], [], [], [])
    postings = ti.trigram_postings(s.artists).cache()
    found = {0: [0, 0], 1: [0, 0]}
    for k in range(40):
        name = rng.choice([n for n in names if len(n) > 7])
        allowed = max(1, len(name) // fuzzy.CHARACTERS_AN_EDIT)
        for more in (0, 1):
            text = list(name)
            for _ in range(allowed + 2 * more):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], ["x"], [text[at], "y"]])
            got = {r.id for r in ti.misspelt_candidates(s.artists, "".join(text), postings).collect()}
            found[more][0] += str(names.index(name)) in got
            found[more][1] += 1
            if k < 5:
                assert got == {r.id for r in ti.misspelt_candidates(s.artists, "".join(text)).collect()}
    assert found[0][0] >= 0.95 * found[0][1] and found[1][0] >= 0.6 * found[1][1], found
    assert ti.artists_search(s, "beetles").count() == 0  # off unless asked for
    best = ti.artists_search(s, "beetles", misspelt=True).first()
    assert "beatles" in best.artist_name and 80 < best.fuzzy_score < 100
    assert ti.artists_search(s, "ab", misspelt=True).count() == ti.artists_search(s, "ab").count()
