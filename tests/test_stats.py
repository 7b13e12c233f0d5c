import datetime as dt

import pytest

from encore.functions.timefn import parse_period, parse_relative_time
from encore.operators import stats


def test_overview(fx1):
    r = stats.overview_stats(fx1).first()
    assert (r.total_scrobbles, r.unique_artists, r.unique_albums, r.unique_tracks) == (10, 2, 3, 5)
    assert r.first_scrobble == dt.datetime(2023, 6, 15, 10) and r.last_scrobble == dt.datetime(2024, 3, 25, 20)


def test_overview_empty(empty):
    r = stats.overview_stats(empty).first()
    assert tuple(r) == (0, 0, 0, 0, None, None)


def test_monthly(fx1):
    rows = stats.monthly_rollup(fx1).collect()
    assert len(rows) == 6
    assert (rows[0].year, rows[0].month, rows[0].scrobbles) == (2024, 3, 3)
    assert len(stats.monthly_rollup(fx1, limit=3).collect()) == 3
    since = stats.monthly_rollup(fx1, since=dt.datetime(2024, 1, 1)).collect()
    assert len(since) == 3 and all(r.year == 2024 for r in since)
    with pytest.raises(ValueError):
        stats.monthly_rollup(fx1, limit=0)


def test_yearly(fx1):
    rows = [(r.year, r.scrobbles) for r in stats.yearly_rollup(fx1).collect()]
    assert rows == [(2024, 6), (2023, 4)]
    assert [r.year for r in stats.yearly_rollup(fx1, limit=1).collect()] == [2024]
    assert len(stats.yearly_rollup(fx1, limit=0).collect()) == 2  # ignored, as in the reference


def test_totals_row(fx1):
    rows = stats.yearly_totals(fx1).collect()
    total = [r for r in rows if r.row_kind == "total"][0]
    assert total.scrobbles == 10 and total.group_count == 2 and total.unique_artists is None
    one = stats.yearly_totals(fx1, limit=1).collect()
    assert all(r.row_kind == "year" for r in one)


def test_top_artists_share_and_rate(fx1):
    rows = stats.top_artists(fx1, since=dt.datetime(2024, 1, 1), until=dt.datetime(2024, 3, 31)).collect()
    assert [r.rank for r in rows] == [1, 2]
    # 3 plays each: the tie is broken by artist id
    assert [(r.artist_id, r.play_count) for r in rows] == [("a1", 3), ("a2", 3)]
    assert rows[0].percentage == pytest.approx(50.0)
    assert rows[0].avg_plays_per_day == pytest.approx(round(3 / 90, 6))


def test_top_tracks_artist_filter(fx1):
    rows = stats.top_tracks(fx1, artist="one").collect()
    assert sum(r.play_count for r in rows) == 7
    assert rows[0].track_id == "t1" and rows[0].percentage == pytest.approx(round(300 / 7, 6))


def test_artists_with_stats_sorts(fx1):
    rows = stats.artists_with_stats(fx1, sort_by="name", order="asc").collect()
    assert [r.artist_name for r in rows] == ["Artist One", "Artist Two"]
    rows = stats.artists_with_stats(fx1, min_plays=5).collect()
    assert [r.artist_id for r in rows] == ["a1"]
    with pytest.raises(ValueError):
        stats.artists_with_stats(fx1, sort_by="bogus")


def test_plays_filtered(fx1):
    rows = stats.plays_filtered(fx1, limit=3, artist="two").collect()
    assert len(rows) == 3 and all(r.artist_name == "Artist Two" for r in rows)
    assert rows[0].timestamp > rows[1].timestamp


def test_monthly_rate_and_gaps(fx1):
    rate = {r.track_id: r for r in stats.track_monthly_rate(fx1).collect()}
    assert rate["t1"].avg_plays_per_month == pytest.approx(3 / 8)
    assert rate["t5"].avg_plays_per_month == 1.0
    gaps = stats.play_gaps(fx1).filter("track_id = 't1'").orderBy("timestamp").collect()
    assert [g.gap_days for g in gaps] == [16, 228, None]
    assert [g.gap_label for g in gaps] == ["16", "228", None]


def test_relative_time():
    now = dt.datetime(2024, 3, 31, 15, 0)
    assert parse_relative_time("today", now) == dt.datetime(2024, 3, 31)
    assert parse_relative_time("yesterday", now) == dt.datetime(2024, 3, 30)
    assert parse_relative_time("1 month ago", now) == dt.datetime(2024, 2, 29, 15, 0)
    assert parse_relative_time("2 weeks ago", now) == now - dt.timedelta(weeks=2)
    assert parse_relative_time("last year", now) == dt.datetime(2023, 3, 31, 15, 0)
    assert parse_relative_time("2024-01-15", now) == dt.datetime(2024, 1, 15)
    assert parse_relative_time("gibberish words", now) is None
    assert parse_period("week", now) == (now - dt.timedelta(days=7), now)
    assert parse_period("all-time", now) == (None, None)
    with pytest.raises(ValueError):
        parse_period("decade", now)


def test_range_counts(fx1, empty):
    as_of = dt.datetime(2024, 3, 31)
    ranges = {
        "all": (None, None), "q1": (dt.datetime(2024, 1, 1), as_of), "2023": (None, dt.datetime(2023, 12, 31)),
        "bounds": (dt.datetime(2024, 1, 15, 14), dt.datetime(2024, 2, 14, 18)), "later": (as_of, None),
    }
    got = {r.range: (r.plays, r.tracks) for r in stats.range_counts(fx1, ranges).collect()}
    assert got == {"all": (10, 5), "q1": (6, 5), "2023": (4, 3), "bounds": (2, 2), "later": (0, 0)}
    got = {r.range: (r.plays, r.tracks) for r in stats.range_counts(empty, ranges).collect()}
    assert got == dict.fromkeys(ranges, (0, 0))
