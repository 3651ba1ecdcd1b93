"""Times: tolerant parsing and differences. The session time zone should be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tolerant_seconds(text: Column, fallback: Column) -> Column:
    """Seconds since 1970 from a number, a numeric text or an ISO time; else the fallback."""
    iso = F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6)
    return F.coalesce(text.try_cast("double"), iso, fallback.cast("double"))


def seconds_all_or_nothing(text: Column, frame_index: Column, every_parsed: Column) -> Column:
    """As tolerant_seconds, but one unreadable time in an episode turns the whole episode to frame indices."""
    return F.when(every_parsed, tolerant_seconds(text, F.lit(None))).otherwise(frame_index.cast("double"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end; works on times with and without a zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def unreadable(text: Column) -> Column:
    return F.try_to_timestamp(text).isNull()
