import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from encore.session import build_session

    s = build_session("local[4]", app_name="encore-tests", shuffle_partitions=4)
    yield s


def ts(text):
    import datetime as dt

    return dt.datetime.fromisoformat(text)


# The rows of FX1-FX3, for which the expected figures are known.
@pytest.fixture
def fx1(spark):
    """FX1 rollup set."""
    from encore.schema import snowflake_from_rows

    plays = [
        ("2023-06-15T10:00:00", "t1"), ("2023-06-16T11:00:00", "t2"), ("2023-07-01T12:00:00", "t1"),
        ("2023-12-25T08:00:00", "t3"), ("2024-01-01T00:00:00", "t4"), ("2024-01-15T14:00:00", "t5"),
        ("2024-02-14T18:00:00", "t1"), ("2024-03-10T09:00:00", "t2"), ("2024-03-20T16:00:00", "t3"),
        ("2024-03-25T20:00:00", "t4"),
    ]
    return snowflake_from_rows(
        spark,
        [("a1", "Artist One"), ("a2", "Artist Two")],
        [("alb1", "Album One", "a1"), ("alb2", "Album Two", "a1"), ("alb3", "Album Three", "a2")],
        [("t1", "Track One", "alb1"), ("t2", "Track Two", "alb1"), ("t3", "Track Three", "alb2"),
         ("t4", "Track Four", "alb3"), ("t5", "Track Five", "alb3")],
        [(ts(t), k) for t, k in plays],
    )


@pytest.fixture
def fx2(spark):
    """FX2 browse set (two unplayed tracks)."""
    from encore.schema import snowflake_from_rows

    plays = [
        ("2024-01-15T10:00:00", "track1"), ("2024-01-16T11:00:00", "track1"), ("2024-01-17T12:00:00", "track1"),
        ("2024-01-10T09:00:00", "track2"), ("2024-01-20T14:00:00", "track3"), ("2024-01-21T15:00:00", "track3"),
        ("2024-01-05T08:00:00", "track4"),
    ]
    return snowflake_from_rows(
        spark,
        [("artist1", "The Beatles"), ("artist2", "Led Zeppelin"), ("artist3", "Pink Floyd")],
        [("album1", "Abbey Road", "artist1"), ("album2", "Led Zeppelin IV", "artist2"),
         ("album3", "The Dark Side of the Moon", "artist3"), ("album4", "Sgt. Pepper's", "artist1")],
        [("track1", "Come Together", "album1"), ("track2", "Something", "album1"),
         ("track3", "Stairway to Heaven", "album2"), ("track4", "Time", "album3"),
         ("track5", "Money", "album3"), ("track6", "Lucy in the Sky", "album4")],
        [(ts(t), k) for t, k in plays],
    )


@pytest.fixture
def fx3(spark):
    """FX3 export set."""
    from encore.schema import snowflake_from_rows

    return snowflake_from_rows(
        spark,
        [("artist-1", "The Beatles"), ("artist-2", "Pink Floyd")],
        [("album-1", "Abbey Road", "artist-1"), ("album-2", "The Dark Side of the Moon", "artist-2")],
        [("track-1", "Come Together", "album-1"), ("track-2", "Something", "album-1"), ("track-3", "Time", "album-2")],
        [(ts("2024-01-15T14:30:00"), "track-1"), (ts("2024-01-16T15:30:00"), "track-2"),
         (ts("2024-01-17T16:30:00"), "track-3")],
    )


@pytest.fixture
def empty(spark):
    from encore.schema import Snowflake, empty_table

    return Snowflake(*(empty_table(spark, n) for n in ("artists", "albums", "tracks", "plays")))
