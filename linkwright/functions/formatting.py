"""Sizes and durations for people to read, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB"]


def size_text(c: Column) -> Column:
    """1536 -> 1.5 KB."""
    out = F.format_string("%.1f TB", F.bround(c / F.lit(float(1 << 40)), 1))
    for k in range(len(UNITS) - 2, -1, -1):
        out = F.when(c < F.lit(1 << 10 * (k + 1)), F.format_string(f"%.1f {UNITS[k]}", F.bround(c / F.lit(float(1 << 10 * k)), 1))).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """3725 -> 1h 2m 5s."""
    s = seconds.cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s >= 3600, F.format_string("%dh %dm %ds", hours, minutes, rest)).when(s >= 60, F.format_string("%dm %ds", minutes, rest)).otherwise(F.format_string("%ds", rest))


def iso_text(c: Column) -> Column:
    """A time as ISO 8601 text; microseconds only where there are any."""
    t = c.cast("timestamp")
    return F.when(F.unix_micros(t) % 1_000_000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def iso_time(c: Column) -> Column:
    """The time that ISO 8601 text stands for; null for other text."""
    return F.try_to_timestamp(c)
