"""Dates and times as the provider writes them, and clock arithmetic in the market zone.

The session zone is the market zone, so wall-clock fields of a timestamp are local.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from navpulse.settings import MarketHours

MINUTE = 60


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact_date(yyyymmdd: Column | str) -> Column:
    """YYYYMMDD to a date, null when it is not one."""
    d = _col(yyyymmdd).cast("long")
    return F.when(
        d > 0, F.try_to_date(F.lpad(d.cast("string"), 8, "0"), "yyyyMMdd")
    )


def compact_time_seconds(hhmmss: Column | str) -> Column:
    """HHMMSS (a leading zero may be lost) to seconds of the day."""
    t = _col(hhmmss).cast("long")
    return F.floor(t / 10000) * 3600 + F.floor(t / 100) % 100 * MINUTE + t % 100


def compact_timestamp(yyyymmdd: Column | str, hhmmss: Column | str) -> Column:
    """Both parts to a timestamp of the session zone; null when either is out of range."""
    d, t = _col(yyyymmdd).cast("int"), _col(hhmmss).cast("int")
    hour, minute, second = F.floor(t / 10000), F.floor(t / 100) % 100, t % 100
    stamp = F.try_make_timestamp(
        F.floor(d / 10000).cast("int"),
        (F.floor(d / 100) % 100).cast("int"),
        (d % 100).cast("int"),
        hour.cast("int"),
        minute.cast("int"),
        # 60 seconds would roll over instead of failing
        F.when(second < 60, second).cast("int"),
    )
    return F.when(d > 0, stamp)


def second_of_day(ts: Column | str) -> Column:
    c = _col(ts)
    return F.hour(c) * 3600 + F.minute(c) * MINUTE + F.second(c)


def floor_minute(ts: Column | str) -> Column:
    return F.date_trunc("minute", _col(ts))


def at_second(day: Column | str, second: Column | int) -> Column:
    """Wall-clock moment of a day."""
    d = _col(day)
    s = F.lit(second) if isinstance(second, int) else second
    zero = F.lit(0)
    return F.make_timestamp(
        F.year(d),
        F.month(d),
        F.day(d),
        F.floor(s / 3600).cast("int"),
        (F.floor(s / MINUTE) % MINUTE).cast("int"),
        (s % MINUTE + zero).cast("int"),
    )


def add_seconds(ts: Column | str, seconds: Column | int) -> Column:
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_add("SECOND", s.cast("int"), _col(ts))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def session_close(day: Column | str, hours: MarketHours) -> Column:
    return at_second(day, hours.close_second)


def in_session(ts: Column | str, trading_day: Column | str, hours: MarketHours) -> Column:
    """Between the bounds, both included, on a day that trades."""
    return _col(trading_day) & second_of_day(ts).between(hours.open_second, hours.close_second)


def status_slot(ins_code: Column | str, ts: Column | str, slots: int = 5) -> Column:
    """True in the minute whose turn it is to refresh this fund's status."""
    return F.crc32(_col(ins_code).cast("binary")) % slots == F.minute(_col(ts)) % slots
