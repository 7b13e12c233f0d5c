"""Date and time functions.

Column functions stay inside Catalyst (``try_to_timestamp``, ``date_format``,
``timestamp_seconds``); only the free-form tail of the timestamp parser (F6) is
a vectorised pandas UDF, and it does parsing work only for values the native
formats could not read.
"""

from __future__ import annotations

import calendar
import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month labels 1..12.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


# ---------------------------------------------------------------- F1-F4 display
def month_label(month: Column) -> Column:
    """1..12 -> ``Jan``..``Dec``, anything else -> the number as text."""
    labels = F.array(*[F.lit(m) for m in MONTH_LABELS])
    return F.when((month >= 1) & (month <= 12), F.element_at(labels, month.cast("int"))).otherwise(
        month.cast("string")
    )


def display_timestamp(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``; text that is not a timestamp is returned as is."""
    parsed = ts if not isinstance(ts, str) else F.col(ts)
    return F.coalesce(
        F.date_format(F.try_to_timestamp(parsed.cast("string")), "yyyy-MM-dd HH:mm:ss"),
        parsed.cast("string"),
    )


def display_minute(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM``, ``-`` when missing."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("-"))


# ---------------------------------------------------------------- F6 parser
def _freeform_one(text: str):
    import dateutil.parser

    try:
        parsed = dateutil.parser.parse(text)
    except (ValueError, TypeError, OverflowError, AttributeError):
        return None
    if parsed.tzinfo is not None:
        parsed = parsed.astimezone(dt.UTC).replace(tzinfo=None)
    return parsed


# Accepted layouts. Dash layouts (date; date + time with
# seconds, minutes or fractions; "T" or space; optional Z) are read by Spark's
# timestamp cast. Slash layouts, tried in this order (month-first first):
SLASH_PATTERNS = ["yyyy/M/d H:m:s", "M/d/yyyy H:m:s", "d/M/yyyy H:m:s", "yyyy/M/d"]
SLASH_SHAPE = r"^\d{1,4}/\d{1,2}/\d{1,4}( \d{1,2}:\d{1,2}:\d{1,2})?$"
ISO_SHAPE = (
    r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?"
    r"(Z|[+-]\d{2}:?\d{2})?$"
)


# What no number looks like: text without a digit, with a mark of dates or times, or that begins as 1996-03. A cast
# that fails costs an exception a row, so such text is not tried.
NO_NUMBER = r"^\D*$|[:/]|^\d+-\d"

# Epoch seconds of the representable years, 1 to 9999: beyond them a number is no instant (so
# milliseconds are rejected, not read as a far year).
EPOCH_LEAST = float((dt.datetime(1, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds())
EPOCH_MOST = float((dt.datetime(9999, 12, 31, 23, 59, 59) - dt.datetime(1970, 1, 1)).total_seconds())


def parse_timestamp(raw: Column, freeform: bool = False) -> Column:
    """text -> UTC instant, or null when nothing understands it.

    Order: a number is epoch seconds (so ``20240115`` is in 1970); then the
    ISO-style layouts (date, ``T`` or space, optional seconds/fraction, ``Z``
    or an offset, converted to UTC) through Spark's own timestamp cast; then
    the slash layouts, month-first before day-first. Each step is guarded by
    a cheap shape test so no layout is tried on text it cannot match. Naive
    times are UTC. ``freeform=True`` adds the free-form parser per row (slow
    path; the loader instead applies it to the distinct failures only).
    """
    text = F.trim(raw.cast("string"))
    num = F.when(~text.rlike(NO_NUMBER), text.try_cast("double"))
    epoch = F.when(
        num.isNotNull() & ~F.isnan(num) & num.between(EPOCH_LEAST, EPOCH_MOST),
        F.timestamp_micros(F.round(num * F.lit(1_000_000)).cast("long")),
    )
    iso = F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp"))
    slash = F.when(
        text.rlike(SLASH_SHAPE),
        F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in SLASH_PATTERNS]),
    )
    native = F.coalesce(epoch, iso, slash)
    if not freeform:
        return native
    return F.coalesce(native, freeform_timestamp(text))


@F.pandas_udf(T.TimestampType())
def freeform_timestamp(text: pd.Series) -> pd.Series:
    """Free-form fallback (dateutil) for text no native layout reads; naive -> UTC."""
    values = [_freeform_one(t) if isinstance(t, str) else None for t in text]
    return pd.Series(pd.to_datetime(values, errors="coerce")).dt.tz_localize("UTC")


# ---------------------------------------------------------------- F14 epoch
def from_epoch_seconds(col: Column) -> Column:
    return F.timestamp_seconds(col.cast("long"))


def to_epoch_seconds(col: Column) -> Column:
    return F.unix_seconds(col)


# ---------------------------------------------------------------- F9/F10 relative
# The accepted phrases. A unit is a number of months or of days.
RELATIVE_UNITS = {"day": (0, 1), "week": (0, 7), "month": (1, 0), "year": (12, 0)}
RELATIVE_DAYS = {"today": 0, "yesterday": 1}
LAST_UNITS = ("week", "month", "year")


def _relative(text: str) -> tuple[int, int] | None:
    """(months, days) back that a phrase names; None if it is none."""
    words = text.split()
    if len(words) >= 2 and words[0] == "last" and words[1] in LAST_UNITS:
        return RELATIVE_UNITS[words[1]]
    if len(words) >= 3 and words[0].isdecimal() and words[2] == "ago":
        unit = RELATIVE_UNITS.get(words[1].removesuffix("s"))
        if unit:
            return tuple(int(words[0]) * x for x in unit)
    return None


def parse_relative_time(text: str, as_of: dt.datetime) -> dt.datetime | None:
    """a phrase before ``as_of``, or a date; None when nothing parses.

    ``today`` and ``yesterday`` are midnights; months and years are calendar
    ones, month ends clamp.
    """
    phrase = text.strip().lower()
    if phrase in RELATIVE_DAYS:
        return dt.datetime.combine(as_of.date(), dt.time()) - dt.timedelta(days=RELATIVE_DAYS[phrase])
    back = _relative(phrase)
    if back is None:
        return _freeform_one(phrase)
    months, days = back
    total = as_of.year * 12 + as_of.month - 1 - months
    year, month = total // 12, total % 12 + 1
    last = calendar.monthrange(year, month)[1]
    return as_of.replace(year=year, month=month, day=min(as_of.day, last)) - dt.timedelta(days=days)


def relative_column(ts: Column, text: str) -> Column:
    """F9 column form: ``ts`` less the phrase (Spark's calendar interval clamps month ends too)."""
    phrase = text.strip().lower()
    if phrase in RELATIVE_DAYS:
        return F.date_trunc("day", ts) - F.make_interval(days=F.lit(RELATIVE_DAYS[phrase]))
    back = _relative(phrase)
    if back is None:
        raise ValueError(f"no relative time: {text}")
    return ts - F.make_interval(months=F.lit(back[0]), days=F.lit(back[1]))


# Period name -> days back.
PERIOD_DAYS = {"week": 7, "month": 30, "quarter": 90, "year": 365}


def parse_period(period: str, as_of: dt.datetime):
    """period -> (since, until); ``all-time`` -> (None, None)."""
    p = period.lower().strip()
    if p == "all-time":
        return None, None
    if p not in PERIOD_DAYS:
        raise ValueError(f"Unknown period: {period}")
    return as_of - dt.timedelta(days=PERIOD_DAYS[p]), as_of
