"""Dates: offsets, truncation, parsing. All in the session's time zone."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit letters (fixed values): year, month, week from Monday, week from Sunday, day, hour, minute, second.
UNITS = {"Y": "year", "M": "month", "W": "week", "w": "week", "d": "day", "h": "hour", "m": "minute", "s": "second"}
MILLIS = {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000}


def offset_millis(text: str) -> int:
    """``1d2h10m3s`` as milliseconds."""
    return sum(int(n) * MILLIS[u] for n, u in re.findall(r"(\d+)([dhms])", text))


def plus_seconds(t: Column, n: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(t.cast("timestamp")) + n.cast("long") * 1000)


def plus_millis(t: Column, n: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(t.cast("timestamp")) + n.cast("long"))


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in whole seconds, truncated toward zero."""
    return ((F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))) / 1000).cast("long")


def truncate(t: Column, unit: str, compat: bool = False) -> Column:
    """To the unit's start. ``compat`` moves a Sunday forward to the next Monday for ``W``."""
    if unit == "w":
        return F.date_trunc("day", F.date_sub(t, F.dayofweek(t) - 1))
    if unit == "W" and compat:
        return F.date_trunc("day", F.date_add(t, 2 - F.dayofweek(t)))
    return F.date_trunc(UNITS[unit], t)


def shift(t: Column, n: int, unit: str) -> Column:
    """n calendar units later."""
    if unit in "YM":
        months = n * (12 if unit == "Y" else 1)
        return t + F.make_ym_interval(F.lit(0), F.lit(months))
    days = n * {"W": 7, "w": 7, "d": 1}.get(unit, 0)
    if days:
        return t + F.expr(f"INTERVAL {days} DAY")
    return t + F.expr(f"INTERVAL {n} {UNITS[unit].upper()}")


def now(text: str = "", at: Column | None = None) -> Column:
    """``now``, ``now(-2d)``: truncated to the unit, then moved."""
    t = F.current_timestamp() if at is None else at
    return moved(t, text) if text else t


def moved(t: Column, text: str) -> Column:
    n, unit = re.fullmatch(r"([-+]?\d+)([YMWwdhms])", text.strip()).groups()
    return shift(truncate(t, unit), int(n), unit)


def literal(text: str) -> Column:
    """A date literal of any precision, such as 2025-08-11T08:36."""
    full = "0001-01-01T00:00:00.000"
    value = dt.datetime.fromisoformat(text + full[len(text) :] if len(text) < len(full) else text)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def parse(x: Column, pattern: str) -> Column:
    """By a pattern, or an epoch: Ts and ts in seconds, TQ and tQ in milliseconds; null if it does not fit."""
    if pattern in ("Ts", "ts"):
        return F.timestamp_seconds(x.try_cast("long"))
    if pattern in ("TQ", "tQ"):
        return F.timestamp_millis(x.try_cast("long"))
    return F.try_to_timestamp(x, F.lit(pattern))


#: Standard macros for dates (fixed values).
PATTERNS = {
    "toDayString": "yyyy-MM-dd", "toMonthString": "yyyy-MM", "toYearString": "yyyy", "toTimeString": "HH:mm:ss",
    "toMinuteString": "yyyy-MM-dd HH:mm", "toHourString": "yyyy-MM-dd HH", "toTimestampString": "yyyy-MM-dd HH:mm:ss",
}


def text(t: Column, macro: str) -> Column:
    return F.date_format(t, PATTERNS[macro])


def time_bucket(t: Column, at: Column, steps: tuple[tuple[str, str], ...] = (("120 MINUTE", "yyyy-MM-dd HH:mm"), ("2 DAY", "yyyy-MM-dd HH"), ("60 DAY", "yyyy-MM-dd")), last: str = "yyyy-MM") -> Column:
    """A timestamp as text, the less precise the older it is at a fixed moment."""
    out = None
    for age, pattern in steps:
        recent = t >= at - F.expr(f"INTERVAL {age}")
        value = F.date_format(t, pattern)
        out = F.when(recent, value) if out is None else out.when(recent, value)
    return out.otherwise(F.date_format(t, last))
