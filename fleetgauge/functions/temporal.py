"""Time helpers: epoch microseconds, unit-boundary differences, labels and durations.

Timestamps are zone-less (``TIMESTAMP_NTZ``); the session time zone is pinned to UTC so the
cast to an instant is a plain relabelling.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 7 * 86_400_000_000,
}
# 1970-01-01 was a Thursday; shifting by three days starts weeks on Monday
_WEEK_SHIFT = 3 * US["day"]
NOT_SET = dt.datetime(2000, 1, 1)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(c) -> Column:
    return F.unix_micros(as_col(c).cast("timestamp"))


def from_us(c) -> Column:
    return F.timestamp_micros(as_col(c)).cast("timestamp_ntz")


def int_div(a, b) -> Column:
    """Integer division that drops the remainder, as the log reports expect."""
    return F.call_function("div", as_col(a), b if isinstance(b, Column) else F.lit(b))


def floor_to(x: Column, size: int) -> Column:
    """Largest multiple of ``size`` not above ``x`` (also for negative ``x``)."""
    return x - F.pmod(x, F.lit(size))


def ceil_to(x: Column, size: int) -> Column:
    return x + F.pmod(-x, F.lit(size))


def boundary_diff(unit: str, start, end) -> Column:
    """How many ``unit`` boundaries lie between two timestamps (not elapsed whole units)."""
    start, end = as_col(start), as_col(end)
    if unit in ("month", "quarter", "year"):
        def number(c):
            if unit == "year":
                return F.year(c)
            return F.year(c) * (12 if unit == "month" else 4) + (F.month(c) if unit == "month" else F.quarter(c))
        return (number(end) - number(start)).cast("long")
    size = US[unit]
    shift = _WEEK_SHIFT if unit == "week" else 0
    return int_div(floor_to(epoch_us(end) + shift, size) - floor_to(epoch_us(start) + shift, size), size)


def hour_of(c) -> Column:
    return F.date_trunc("hour", as_col(c)).cast("timestamp_ntz")


def day_of(c) -> Column:
    return as_col(c).cast("date")


def at(as_of) -> Column:
    """A reference time as a zone-less timestamp column; accepts text, datetime or Column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def within(c, as_of, lookback_days: float | None) -> Column:
    """``c`` lies in the last ``lookback_days`` up to ``as_of``, or anywhere up to it without a lookback.

    Always true without ``as_of``, which a lookback cannot do without.
    """
    if as_of is None:
        if lookback_days is not None:
            raise ValueError("a lookback needs as_of")
        return F.lit(True)
    upto = as_col(c) <= at(as_of)
    if lookback_days is None:
        return upto
    edge = dt.datetime.fromisoformat(str(as_of)) - dt.timedelta(days=lookback_days)
    return upto & (as_col(c) >= at(edge.isoformat(sep=" ")))


def unset_to_null(c) -> Column:
    """The sentinel 2000-01-01 00:00:00 means the stage never happened."""
    return F.nullif(as_col(c), F.lit(NOT_SET.isoformat(sep=" ")).cast("timestamp_ntz"))


def human_duration(seconds: Column) -> Column:
    """``90061`` -> ``1 days 1hrs 1mins 1secs``."""
    s = seconds.cast("long")
    return F.concat(
        int_div(s, 86400).cast("string"), F.lit(" days "),
        int_div(s % 86400, 3600).cast("string"), F.lit("hrs "),
        int_div(s % 3600, 60).cast("string"), F.lit("mins "),
        (s % 60).cast("string"), F.lit("secs"),
    )


def week_starting_sunday(ts) -> Column:
    d = day_of(ts)
    return F.date_format(F.date_sub(d, F.dayofweek(d) - 1), "yyyy-MM-dd")


def day_name(d) -> Column:
    return F.date_format(as_col(d), "EEEE")


def month_name(d) -> Column:
    return F.date_format(as_col(d), "MMMM")
