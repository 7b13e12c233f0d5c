"""The loader's steps: what each of its results reads, and that names in several forms come out as before."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from encore.functions.timefn import parse_timestamp
from encore.functions.tokenize import tokens
from encore.operators.ingest import LoadOptions, _latest_names, dry_run, plan_load
from encore.operators.store import SnowflakeStore
from encore.operators.textindex import by_token
from encore.schema import snowflake_from_rows


def records(spark, rows):
    """(time, artist, artist id, album, album id, track, track id); None is left out."""
    keys = ["timestamp", "artist", "artist_id", "album", "album_id", "track", "track_id"]
    out = [({k: v for k, v in zip(keys, r, strict=True) if v is not None}, None, "f", 0, n) for n, r in enumerate(rows)]
    return spark.createDataFrame(out, "fields map<string,string>, parse_error string, _file string, _block long, _pos long")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


ROWS = [
    ("2024-01-01", "A", None, "X", None, "one", None),
    ("2024-01-02", "A", None, "X", None, "two", None),
    ("2024-01-01", "A", None, "X", None, "one", None),
    ("2024-01-03", "B", "b", "Y", "y", "three", "t"),
    ("2024-01-03", "B late", "b", "Z", "z", "three again", "t"),
    ("2024-01-04", "B now", "b", "Y", "y", "three", "t"),
    ("2024-01-04", "C", "c", "W", "w", "three", "t"),
    ("2024-01-05", "D", "d", "V", "v", "four", "u"),
    (None, "A", None, "X", None, "one", None),
]


def test_results_do_not_mark_repeats(spark):
    plan = plan_load(records(spark, ROWS), LoadOptions(skip_errors=True, no_duplicates=True))
    s = plan.normalised()
    for df in (s.plays, plan.rejects(), plan.summary()):
        assert "Join" not in plan_of(df)
    assert s.plays.count() == 5 and plan.rejects().count() == 1
    r = plan.summary().first()
    assert (r.total_processed, r.added, r.skipped, r.errors) == (9, 5, 3, 1)
    assert (r.first_timestamp, r.last_timestamp) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5))
    one = plan_load(records(spark, ROWS[:3]), LoadOptions(no_duplicates=True)).normalised()
    assert not any("Join" in plan_of(df) for df in (one.artists, one.albums, one.tracks, one.plays))


def test_names_in_several_forms(spark):
    for options in (LoadOptions(skip_errors=True, no_duplicates=True), LoadOptions(skip_errors=True), LoadOptions(skip_errors=True, no_duplicates=True, limit=4)):
        plan = plan_load(records(spark, ROWS), options)
        s = plan.normalised()
        for got, want in zip((s.artists, s.albums, s.tracks), _latest_names(plan.added), strict=True):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        # a name that only a repeat has is no row
        assert ("c" in {r.id for r in s.artists.collect()}) == (not options.no_duplicates)


def test_dry_run_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    told = F.udf(told, "string").asNondeterministic()
    rows = records(spark, ROWS).withColumn("parse_error", told("parse_error"))
    options = LoadOptions(skip_errors=True, no_duplicates=True)
    assert dry_run(rows, options).collect() == plan_load(records(spark, ROWS), options).summary().collect()
    assert seen.value == len(ROWS)


def test_upsert_makes_the_batch_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    s = snowflake_from_rows(spark, [("a", "A")], [("b", "B", "a")], [("t", "T", "b")], [(dt.datetime(2024, m, 1), "t") for m in range(1, 6)])
    plays = s.plays.withColumn("track_id", F.udf(told, "string").asNondeterministic()("track_id"))
    store = SnowflakeStore(spark, tempfile.mkdtemp(prefix="encore-once-"))
    assert store.upsert_plays(plays) == [f"2024-0{m}" for m in range(1, 6)]
    assert seen.value == 5
    store.upsert_plays(plays)
    assert store.read().plays.count() == 5 and seen.value == 10


def test_numbers_and_times(spark):
    texts = ["1e9", "0x1p30", " 1705329000 ", "-1.5E2", "1e-3", "12d", "NaN", "Infinity", "1705329000000", "no time", "1996-03-13 00:00:00", "3/4/1996 00:00:00", "1996-3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    number = F.trim("t").try_cast("double")
    told = rows.select("t", parse_timestamp(F.col("t")).alias("ts"), number.alias("n")).collect()
    for r in told:
        if r.n is not None and abs(r.n) < 1e11:
            assert r.ts == dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=round(r.n * 1e6)), r.t
    assert [r.ts for r in told[-7:-3]] == [None] * 4 and told[-3].ts == dt.datetime(1996, 3, 13) and told[-2].ts == dt.datetime(1996, 3, 4)
    # a cast that fails is not tried on what is no number
    assert "rlike" in rows.select(parse_timestamp(F.col("t")))._jdf.queryExecution().analyzed().toString().lower().split("try_cast")[0]


def test_postings_are_dealt_by_hash(spark):
    docs = spark.createDataFrame([("1", "Élan vital, K plain"), ("2", "plain ASCII 12"), ("3", "élan")], "doc_id string, text string")
    post = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    assert sorted((r.doc_id, r.token) for r in by_token(post).collect()) == [
        ("1", "elan"), ("1", "k"), ("1", "plain"), ("1", "vital"), ("2", "12"), ("2", "ascii"), ("2", "plain"), ("3", "elan"),
    ]
    plan = by_token(post)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(token" in plan
