"""Pages and order statistics by counts (L1, L3), blocked positions (Q29), profiles (Q30), distinct counts (A3)."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from encore.operators import profile
from encore.operators.distinct import DistinctCounts
from encore.operators.ranking import positions
from encore.operators.selection import Key, first_rows, keys_of, kth, not_after, not_before, sorted_range
from encore.schema import Snowflake, snowflake_from_rows


@pytest.fixture(scope="module")
def rows(spark):
    """Ties, nulls and nan in the keys; a number that tells the rows apart."""
    rng = random.Random(3)
    data = [
        (k, rng.choice([None, 1, 2, 3]), rng.choice([None, "", "a", "B", "é", "zz"]), rng.choice([None, math.nan, -0.5, 0.0, 2.5]),
         rng.choice([None, dt.datetime(2024, 1, 1), dt.datetime(1999, 5, 5, 3)]))
        for k in range(700)
    ]
    return spark.createDataFrame(data, "k int, a int, s string, d double, t timestamp").repartition(5).cache()


ORDERS = [
    [Key("a", True), Key("k")],
    [Key("a", nulls_first=False), Key("s", True, nulls_first=True), Key("k", True)],
    [Key("s"), Key("d", True), Key("t"), Key("k")],
    [Key("d"), Key("k")],
    [Key("t", True), Key("a"), Key("k")],
]


@pytest.mark.parametrize("keys", ORDERS)
def test_pages_equal_the_sorted_table(rows, keys):
    want = [r.k for r in rows.orderBy(*[x.order for x in keys]).collect()]
    for offset, limit in ((0, 10), (3, 5), (333, 40), (690, 50), (699, 1), (700, 5), (2000, 5), (0, 700)):
        got = [r.k for r in sorted_range(rows, keys, offset, limit, range_rows=60, ranges=4).collect()]
        assert got == want[offset : offset + limit], (offset, limit)


def test_bounds_compare_as_sorting_does(rows):
    for keys in ORDERS:
        ordered = rows.orderBy(*[x.order for x in keys]).collect()
        for at in (0, 100, 350, 699):
            assert rows.filter(not_before(keys, ordered[at])).count() == 700 - at
            assert rows.filter(not_after(keys, ordered[at])).count() == at + 1


def test_kth(rows):
    keys = keys_of("s", "k")
    want = [(r.s, r.k) for r in rows.orderBy("s", "k").collect()]
    for k in (1, 2, 351, 700):
        assert tuple(kth(rows, keys, k, range_rows=20, ranges=3)) == want[k - 1]
    assert kth(rows, keys, 701, range_rows=20) is None and kth(rows.limit(0), keys, 1) is None


def test_equal_keys_end(spark):
    same = spark.createDataFrame([(1,)] * 300, "x int")
    assert sorted_range(same, keys_of("x"), 250, 10, range_rows=20, ranges=4).count() == 10


def test_a_deep_page_sorts_its_own_range_only(rows):
    page = sorted_range(rows, keys_of("k"), 600, 5, range_rows=60, ranges=8)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" in plan and "Filter" in plan
    assert "Offset 600" not in plan


def test_positions(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaaaaaab"), rng.randrange(50), k) for k in range(900)] + [("only", 1, 1000)]
    df = spark.createDataFrame(data, "g string, v int, k int")
    got = positions(df, ["g"], [Key("v", True), Key("k")], "at", 0).collect()
    want = {}
    for g, v, k in sorted(data, key=lambda r: (r[0], -r[1], r[2])):
        want[k] = sum(1 for x in want.values() if x[0] == g), g
        want[k] = (g, want[k][0])
    assert len(got) == len(data) and all(want[r.k] == (r.g, r.at) for r in got)
    assert positions(df.limit(0), ["g"], [Key("k")]).collect() == []


def test_profile_of_odd_values(spark):
    data = [
        ("", 0.0, [1, 2], b"\xff", True), (None, -0.0, None, b"\xfe", None), ("x", math.nan, [], None, False), ("x", math.nan, [1, 2], b"\xff", True),
    ]
    df = spark.createDataFrame(data, "s string, d double, l array<int>, b binary, `odd name` boolean")
    got = {r.column_name: (r.total_rows, r.num_null, r.num_blank, r.num_distinct) for r in profile.analyze_columns(df, "t").collect()}
    assert got == {"s": (4, 1, 1, 2), "d": (4, 0, 0, 2), "l": (4, 1, 0, 2), "b": (4, 1, 0, 2), "odd name": (4, 1, 0, 2)}
    assert "Expand" not in profile.analyze_columns(df, "t")._jdf.queryExecution().executedPlan().toString()
    empty = profile.analyze_columns(df.limit(0), "t", ["s", "d"]).collect()
    assert sorted((r.column_name, r.total_rows, r.num_distinct) for r in empty) == [("d", 0, 0), ("s", 0, 0)]
    least = profile.common_values(df, "t", ["s"], limit=5, most=False).collect()
    assert [(r.rank, r.value, r["count"]) for r in sorted(least, key=lambda r: r.rank)] == [(1, None, 1), (2, "", 1), (3, "x", 2)]
    with pytest.raises(ValueError):
        profile.common_values(df, "t", most=False, least=False)


def test_distinct_counts(spark, tmp_path):
    rng = random.Random(8)
    artists = [(f"a{k}", f"A{k}") for k in range(3)]
    albums = [(f"b{k}", f"B{k}", f"a{k % 3}") for k in range(9)]
    tracks = [(f"t{k}", f"T{k}", f"b{k % 9}") for k in range(60)]
    plays = [(dt.datetime(2024, rng.randrange(1, 7), rng.randrange(1, 28)), f"t{rng.randrange(60)}") for _ in range(400)]
    s = snowflake_from_rows(spark, artists, albums, tracks, plays)
    counts = DistinctCounts(spark, str(tmp_path / "counts"))
    with pytest.raises(ValueError):
        counts.estimate()
    part = F.pmod(F.xxhash64("timestamp", "track_id"), F.lit(3))
    for k in (2, 0, 1):
        counts.add(Snowflake(s.artists, s.albums, s.tracks, s.plays.filter(part == k)))
    for since, until in (("2024-02", "2024-04"), (None, "2024-01"), ("2024-06", None), (None, None)):
        own = [(t, k) for t, k in plays if (since or "") <= t.strftime("%Y-%m") <= (until or "9")]
        t = {k for _, k in own}
        b = {f"b{int(k[1:]) % 9}" for k in t}
        want = (len({int(k[1:]) % 3 for k in b}), len(b), len(t), len(own))
        assert tuple(counts.exact(s, since, until).first()) == want
        assert tuple(counts.estimate(since, until).first()) == want  # few values: sketches are exact
    counts.take_back(s.plays.filter("track_id <> 't1'"))
    assert tuple(counts.exact(s).first()) == (1, 1, 1, sum(k == "t1" for _, k in plays))
    plan = counts.estimate("2024-02", "2024-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_first_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(15)]), rng.choice("abcd")) for _ in range(500)]
    df = spark.createDataFrame(rows, "n int, c string").repartition(5)
    keys = [Key("n", descending=True), Key("c")]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for k in (0, 1, 63, 64, 250, 499, 500, 900):  # rows repeat, so most cuts fall between equal ones
        assert [tuple(r) for r in first_rows(df, keys, k, range_rows=20).collect()] == want[:k], k
    assert first_rows(df.limit(0), keys, 50, range_rows=20).collect() == []
