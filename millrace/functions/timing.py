"""Time columns and durations."""

import re

from pyspark.sql import functions as F

from .numbers import divided

_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def micros(interval):
    """``"2 seconds"`` -> 2000000."""
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", interval)
    if not match or match.group(2) not in _UNIT_MICROS or int(match.group(1)) < 1:
        raise ValueError(f"not a positive interval: {interval!r}")
    return int(match.group(1)) * _UNIT_MICROS[match.group(2)]


def as_instant(column):
    """TIMESTAMP from TIMESTAMP_NTZ read as UTC, whatever the session time zone is.

    Event-time operators refuse TIMESTAMP_NTZ, so every loader passes its time through here.
    """
    return F.timestamp_micros(
        F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), column)
    )


def tick_of(column, interval):
    """Number of the epoch-aligned tick an instant falls into (integer arithmetic)."""
    width = micros(interval)
    value = F.unix_micros(column)
    return divided(value - F.pmod(value, F.lit(width)), width)
