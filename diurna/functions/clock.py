"""Date, clock and circular-time expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(text: Column, zone: str = "Asia/Seoul") -> Column:
    """ISO text with an offset to wall-clock time in ``zone``; bad text is NULL."""
    instant = F.try_to_timestamp(text).cast("timestamp_ntz")  # rendered in the session zone
    return F.convert_timezone(F.current_timezone(), F.lit(zone), instant)


def naive_local(text: Column) -> Column:
    """First 19 characters read as wall-clock time, offset ignored."""
    return F.substring(text, 1, 19).try_cast("timestamp_ntz")


def shifted_day(ts: Column, boundary_hour: int = 4) -> Column:
    """Hours before the boundary belong to the previous date."""
    return F.to_date(ts - F.expr(f"interval {boundary_hour} hours"))


def clock_hour(ts: Column) -> Column:
    """hour + minute/60 + whole second/3600."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.floor(F.second(ts)) / F.lit(3600.0)


def unwrap_bedtime(h: Column) -> Column:
    return F.when(h < 12, h + 24).otherwise(h)


def circular_midpoint(start: Column, end: Column) -> Column:
    """Midpoint of the forward arc from start to end on a 24 h clock."""
    return F.pmod(start + F.pmod(end - start, F.lit(24.0)) / 2, F.lit(24.0))


def hour_sin(h: Column) -> Column:
    return F.sin(h * (2 * math.pi / 24))


def hour_cos(h: Column) -> Column:
    return F.cos(h * (2 * math.pi / 24))


def circular_gap(h: Column, reference: Column) -> Column:
    """Signed hours from a reference hour, in [-12, 12)."""
    return F.pmod(h - reference + 12, F.lit(24.0)) - 12


def four_hour_bins(h: Column) -> list[Column]:
    """Six 0/1 flags, one per four-hour block of the day."""
    return [(F.floor(h / 4) == i).cast("bigint").alias(f"bin_{i}") for i in range(6)]


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def bounded_hours(start: Column, end: Column, low: float = 0.0, high: float = 48.0) -> Column:
    d = seconds_between(start, end) / 3600
    return F.when((d >= low) & (d <= high), d)
