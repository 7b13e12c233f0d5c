"""Upserts (K1/K2), streaming replay (R1-R5) and ad-hoc SQL."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from encore.operators import adhoc, profile
from encore.operators.store import SnowflakeStore
from encore.schema import snowflake_from_rows


def batch(spark, name="The Beatles", plays=(("2024-01-15T14:30:00", "t1"),)):
    return snowflake_from_rows(
        spark,
        [("a1", name)],
        [("al1", "Abbey Road", "a1")],
        [("t1", "Come Together", "al1")],
        [(dt.datetime.fromisoformat(t), k) for t, k in plays],
    )


def test_upsert_idempotent_and_last_wins(spark):
    store = SnowflakeStore(spark, tempfile.mkdtemp(prefix="encore-store-"))
    store.commit(batch(spark))
    store.commit(batch(spark))  # replay: nothing new
    s = store.read()
    assert s.plays.count() == 1 and s.artists.count() == 1
    store.commit(batch(spark, "Beatles, The", plays=(("2024-02-01T00:00:00", "t1"),)))
    s = store.read()
    assert [r.name for r in s.artists.collect()] == ["Beatles, The"]
    assert s.plays.count() == 2


def test_stream_replay(spark):
    from encore.streaming.ingest import resume_since, start_ingest

    d = tempfile.mkdtemp(prefix="encore-stream-")
    os.makedirs(f"{d}/landing")
    for i in range(3):
        with open(f"{d}/landing/part{i}.jsonl", "w") as f:
            for j in range(4):
                f.write(f'{{"timestamp": "2024-01-{10 + i}T10:0{j}:00", "artist": "A{i}", "track": "T{j}"}}\n')
            f.write('{"timestamp": "2024-01-10T10:00:00", "artist": "A0", "track": "T0"}\n')  # duplicate
    start_ingest(spark, f"{d}/landing", f"{d}/store", f"{d}/ck1", max_files_per_trigger=1).awaitTermination()
    store = SnowflakeStore(spark, f"{d}/store")
    assert store.read().plays.count() == 12
    start_ingest(spark, f"{d}/landing", f"{d}/store", f"{d}/ck2").awaitTermination()
    assert store.read().plays.count() == 12
    assert resume_since(store) == dt.datetime(2024, 1, 12, 10, 3)


def test_failed_read_aborts_commit(spark):
    """A table that cannot be read is not an empty table."""
    root = tempfile.mkdtemp(prefix="encore-store-")
    store = SnowflakeStore(spark, root)
    store.commit(batch(spark))
    month = os.path.join(root, "plays", "month=2024-01")
    with open(os.path.join(month, "part-broken.parquet"), "wb") as f:
        f.write(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        store.commit(batch(spark, "Other"))
    os.remove(os.path.join(month, "part-broken.parquet"))
    assert store.read().plays.count() == 1


def test_scheme_root_and_pruned_months(spark):
    root = "file:" + tempfile.mkdtemp(prefix="encore-store-")
    store = SnowflakeStore(spark, root)
    for _ in range(2):
        store.commit(batch(spark, plays=(("2024-01-15T14:30:00", "t1"), ("2023-06-01T00:00:00", "t1"))))
    assert store.read().plays.count() == 2
    plan = store.read_plays(["2024-01"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01" in plan.split("PartitionFilters")[1]


def test_rejects_and_late_plays(spark):
    from encore.operators.stats import monthly_rollup
    from encore.streaming.ingest import live_monthly_rollup, read_monthly_rollup, start_ingest

    d = tempfile.mkdtemp(prefix="encore-late-")
    store = SnowflakeStore(spark, f"{d}/store")
    drops = [
        [(f"2024-01-{day:02d}", "A", f"T{day}") for day in range(1, 32)],
        [("2023-06-05", "B", "T1"), ("2024-01-31", "C", "T2"), ("2024-01-01", "A", "T1")],
    ]
    for i, rows in enumerate(drops):
        os.makedirs(f"{d}/in{i}")
        with open(f"{d}/in{i}/a.jsonl", "w") as f:
            f.writelines(f'{{"timestamp": "{t}", "artist": "{a}", "track": "{k}"}}\n' for t, a, k in rows)
            f.write("{broken\n")
        start_ingest(spark, f"{d}/in{i}", store.root, f"{d}/ck{i}", on_batch=live_monthly_rollup(store, f"{d}/rollup")).awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.select("year", "month", "scrobbles", "unique_artists", "unique_tracks").collect())
    assert key(read_monthly_rollup(spark, f"{d}/rollup")) == key(monthly_rollup(store.read())) == [(2023, 6, 1, 1, 1), (2024, 1, 32, 2, 32)]
    rejects = store.read_rejects().collect()
    assert len(rejects) == 2 and {r.reason for r in rejects} == {"Invalid JSON"}


def test_bounded_replay(spark):
    from encore.streaming.ingest import start_ingest

    d = tempfile.mkdtemp(prefix="encore-range-")
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.jsonl", "w") as f:
        f.writelines(f'{{"timestamp": "2024-01-{day:02d}", "artist": "A", "track": "T"}}\n' for day in range(1, 11))
    start_ingest(
        spark, f"{d}/in", f"{d}/store", f"{d}/ck", since=dt.datetime(2024, 1, 3), until=dt.datetime(2024, 1, 5)
    ).awaitTermination()
    assert SnowflakeStore(spark, f"{d}/store").read().plays.count() == 3


def test_stored_snowflake_and_listing(spark, fx3):
    from encore.sources.tables import read_snowflake_dir

    root = tempfile.mkdtemp(prefix="encore-dir-")
    fx3.tracks.write.parquet(f"{root}/tracks")
    s = read_snowflake_dir(spark, root)
    assert s.tracks.count() == 3 and s.plays.count() == 0 and s.artists.columns == fx3.artists.columns
    fx3.tracks.createOrReplaceTempView("listed_tracks")
    assert "listed_tracks" in {r.tableName for r in profile.catalog_listing(spark).collect()}


def test_file_names_must_differ(spark):
    d = tempfile.mkdtemp(prefix="encore-files-")
    for sub in ("a", "b"):
        os.makedirs(f"{d}/{sub}")
        with open(f"{d}/{sub}/t.csv", "w") as f:
            f.write("x\n1\n")
    with pytest.raises(ValueError, match="two files"):
        adhoc.load_files(spark, [f"{d}/a/t.csv", f"{d}/b/t.csv"])


def test_save_and_shapes(spark):
    import json

    from encore.operators.output import ARTIST_FIELDS, as_lines, select_fields
    from encore.operators.store import read_if_present, save_table

    path = tempfile.mkdtemp(prefix="encore-save-") + "/t"
    assert read_if_present(spark, path) is None
    df = spark.createDataFrame([(1, 'x"y', '{"k": [1, 2]}'), (2, None, "{bad")], "artist_id int, artist_name string, j string")
    save_table(df, path)
    df = read_if_present(spark, path).orderBy("artist_id")
    assert [json.loads(r.value) for r in as_lines(df, "arrays").collect()] == [[1, 'x"y', '{"k": [1, 2]}'], [2, None, "{bad"]]
    objects = [json.loads(r.value) for r in as_lines(df, json_cols=True).collect()]
    assert objects == [{"artist_id": 1, "artist_name": 'x"y', "j": {"k": [1, 2]}}, {"artist_id": 2, "artist_name": None, "j": "{bad"}]
    assert [r.value for r in as_lines(df, "raw_lines").collect()] == ["1", "2"] and as_lines(df, "raw").count() == 1
    assert select_fields(df, ["artist", "nothing", "id"], ARTIST_FIELDS).columns == ["artist_name", "artist_id"]


def test_sql_and_rows(fx3, spark):
    adhoc.register_snowflake(fx3, prefix="fx3_")
    r = adhoc.sql_query(spark, "SELECT COUNT(*) AS n FROM fx3_plays WHERE timestamp > :d",
                        {"d": dt.datetime(2024, 1, 16)}).first()
    assert r.n == 2
    rows = adhoc.table_rows(spark, "fx3_tracks", columns=["title"], order="title desc", limit=2, offset=1).collect()
    assert [x.title for x in rows] == ["Something", "Come Together"]
    for bad in ["title; DROP TABLE x", "title desc, (select 1)", "nosuch"]:
        with pytest.raises(ValueError):
            adhoc.parse_order(bad, ["title", "id"])
    with pytest.raises(ValueError):
        adhoc.table_rows(spark, "fx3_tracks", columns=["nope"])
    adhoc.register_functions(spark, {"shout": lambda s: s.upper()})
    assert spark.sql("SELECT shout(title) AS t FROM fx3_tracks ORDER BY t").first().t == "COME TOGETHER"


def test_profile(fx2):
    p = {r.column_name: r for r in profile.analyze_columns(fx2.tracks, "tracks").collect()}
    assert p["album_id"].num_distinct == 4 and p["album_id"].total_rows == 6 and p["title"].num_null == 0
    common = profile.common_values(fx2.tracks, "tracks", ["album_id"], limit=1).collect()
    most = [r for r in common if r.kind == "most"][0]
    assert (most["value"], most["count"]) == ("album1", 2)
    ov = {r.table_name: r.row_count for r in profile.table_overview({"t": fx2.tracks, "p": fx2.plays}).collect()}
    assert ov == {"t": 6, "p": 7}


def test_files_query(spark):
    d = tempfile.mkdtemp(prefix="encore-files-")
    with open(f"{d}/people.csv", "w") as f:
        f.write("name,age\nann,30\nbob,40\n")
    with open(f"{d}/nested.json", "w") as f:
        f.write('{"a": {"b": 1}, "c": 2}\n')
    r = adhoc.files_query(spark, [f"{d}/people.csv"], "SELECT SUM(age) AS s FROM people").first()
    assert r.s == 70
    r = adhoc.files_query(spark, [f"{d}/nested.json"], "SELECT a_b FROM nested", flatten=True).first()
    assert r.a_b == 1
    r = adhoc.files_query(spark, [f"{d}/people.csv"], "SELECT typeof(age) AS t FROM people", detect_types=False).first()
    assert r.t == "string"


def test_entry_contract(spark):
    import __spark_entry__ as E

    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["year", "month"]
    assert F is not None


def test_plays_files_by_month(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from encore.operators import store as store_module

    monkeypatch.setattr(store_module, "PLAYS_A_FILE", 100)
    store = store_module.SnowflakeStore(spark, str(tmp_path / "s"))
    hour = lambda start, n: spark.range(n, numPartitions=6).select(
        F.timestamp_seconds(F.lit(start) + F.col("id") * 60).alias("timestamp"), (F.col("id") % 7).cast("string").alias("track_id")
    )
    small, large = hour(1704067200, 50), hour(1706745600, 950)
    both = small.unionByName(large)
    assert store.upsert_plays(both) == ["2024-01", "2024-02"]
    files = {m: len(list((tmp_path / "s" / "plays" / f"month={m}").glob("*.parquet"))) for m in ("2024-01", "2024-02")}
    assert files["2024-01"] == 1 and 2 <= files["2024-02"] <= 10
    store.upsert_plays(both)
    assert sorted(store.read().plays.collect()) == sorted(both.collect())
    assert store.upsert_plays(both.filter("false")) == []
