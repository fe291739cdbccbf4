"""Timestamp scalars. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import trim

CANONICAL_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Microseconds between 1601 and 1970, and the first tick count
# (100 ns units) past the year 9999. The "never" value is far beyond it.
FILETIME_EPOCH_MICROS = 11644473600000000
FILETIME_END = 2650467744000000000


def canonical_ts(value: Column) -> Column:
    """Text to timestamp: offsets convert to UTC, text without an offset is
    taken as is, unparseable text is NULL."""
    text = trim(value)
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
    return F.try_to_timestamp(dated)


def canonical_timestamp_sort(value: Column) -> Column:
    """Canonical sortable text of a timestamp text."""
    return F.date_format(canonical_ts(value), CANONICAL_FORMAT)


def format_ts(value: Column) -> Column:
    """Canonical sortable text of a timestamp."""
    return F.date_format(value, CANONICAL_FORMAT)


def micros(value: Column) -> Column:
    """Microseconds since 1970 as a long."""
    return F.unix_micros(value.cast("timestamp"))


def delta_seconds(left: Column, right: Column) -> Column:
    """Absolute distance in seconds with microsecond precision."""
    return F.abs(micros(left) - micros(right)) / F.lit(1e6)


def filetime_to_ts(ticks: Column) -> Column:
    """100 ns ticks since 1601 to timestamp; zero and out-of-range are NULL."""
    valid = (ticks > 0) & (ticks < F.lit(FILETIME_END))
    since_1601 = F.floor(ticks.cast("decimal(20,0)") / 10).cast("long")
    return F.when(valid, F.timestamp_micros(since_1601 - F.lit(FILETIME_EPOCH_MICROS)))
