"""Time operators (T1-T9) as Column expressions.

All of these are time-zone independent for ``timestamp_ntz`` input and use the
session zone for ``timestamp`` input; tests pin the session zone to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Fixed value: bucket origin of n-minute time groups is 1900-01-01 00:00.
TIME_GROUP_ORIGIN = "1900-01-01 00:00:00"

# Automatic report interval by report window (hours -> minutes).
AUTO_INTERVAL_STEPS = ((1, 2), (4, 5), (24, 15), (168, 60), (720, 360))
AUTO_INTERVAL_DEFAULT = 5
AUTO_INTERVAL_MAX = 1440


def trunc_ntz(unit: str, ts) -> Column:
    """``date_trunc`` that keeps wall-clock (``timestamp_ntz``) semantics.

    Spark's ``date_trunc`` returns a session-zone ``timestamp``; casting back
    keeps results independent of the session time zone.
    """
    return F.date_trunc(unit, col(ts)).cast("timestamp_ntz")


def _origin() -> Column:
    return F.lit(TIME_GROUP_ORIGIN).cast("timestamp_ntz")


def time_group(ts, minutes: int) -> Column:
    """Floor ``ts`` to an n-minute bucket counted from 1900-01-01."""
    ts = col(ts)
    elapsed = F.timestamp_diff("MINUTE", _origin(), ts.cast("timestamp_ntz"))
    bucket = F.floor(elapsed / F.lit(minutes)) * F.lit(minutes)
    return F.timestamp_add("MINUTE", bucket, _origin())


def auto_interval(report_hours: float | None) -> int:
    """Bucket width in minutes for a report window of ``report_hours``."""
    if report_hours is None:
        return AUTO_INTERVAL_DEFAULT
    for limit, minutes in AUTO_INTERVAL_STEPS:
        if report_hours <= limit:
            return minutes
    return AUTO_INTERVAL_MAX


def report_time(ts, offset_minutes=None) -> Column:
    """Ceil a whole-second timestamp to the minute, shifted to local time (T4)."""
    ceiled = trunc_ntz("minute", col(ts) + F.expr("INTERVAL 59 SECONDS"))
    if offset_minutes is None:
        return ceiled
    return F.timestamp_add("MINUTE", col(offset_minutes), ceiled)


def to_local(ts_utc, offset_minutes) -> Column:
    """UTC -> local time by a minute offset (T5)."""
    return F.timestamp_add("MINUTE", col(offset_minutes), col(ts_utc))


def to_utc(ts_local, offset_minutes) -> Column:
    """Local -> UTC time by a minute offset (T5)."""
    return F.timestamp_add("MINUTE", -col(offset_minutes), col(ts_local))


_TRUNC = {"year": "year", "month": "month", "day": "day", "hour": "hour",
          "minute": "minute", "second": "second"}


def datediff_boundary(unit: str, start, end) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end``.

    Differs from elapsed units: 00:59 -> 01:01 is one hour boundary.
    """
    unit = unit.lower()
    a = trunc_ntz(_TRUNC[unit], col(start))
    b = trunc_ntz(_TRUNC[unit], col(end))
    return F.timestamp_diff(unit.upper(), a, b)


def hhmmss_to_seconds(value) -> Column:
    """Integer HHMMSS (e.g. 12345 = 1h23m45s) -> seconds."""
    v = col(value).cast("bigint")
    return (v / 10000).cast("bigint") * 3600 + ((v / 100).cast("bigint") % 100) * 60 + v % 100


def yyyymmdd_hhmmss_to_ts(date_int, time_int) -> Column:
    """Integer date 20240131 plus integer time 134501 -> timestamp."""
    d = col(date_int).cast("bigint")
    t = col(time_int).cast("bigint")
    return F.make_timestamp_ntz(
        (d / 10000).cast("int"), ((d / 100).cast("bigint") % 100).cast("int"), (d % 100).cast("int"),
        (t / 10000).cast("int"), ((t / 100).cast("bigint") % 100).cast("int"), (t % 100).cast("int"))


def add_duration_ms(ts, ms) -> Column:
    """``ts`` + milliseconds, without the overflow switch to seconds."""
    return F.timestamp_add("MILLISECOND", col(ms).cast("bigint"), col(ts))


def us_week_of_year(ts) -> Column:
    """Sunday-based week number: floor((doy + dow(Jan 1) - 2) / 7) + 1 (Q9)."""
    ts = col(ts)
    jan1 = F.make_date(F.year(ts), F.lit(1), F.lit(1))
    return (F.floor((F.dayofyear(ts) + F.dayofweek(jan1) - 2) / 7) + 1).cast("int")
