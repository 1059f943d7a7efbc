"""Epoch seconds on the wire, instants in tables, epoch millis in replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds that a timestamp can hold: 4713-01-01 BC and the last whole second
# of a 64-bit count of microseconds.
MIN_SECONDS = -210866803200
MAX_SECONDS = 9223372036854


def storable_seconds(seconds: Column) -> Column:
    return seconds.between(MIN_SECONDS, MAX_SECONDS)


def seconds_to_timestamp(seconds: Column) -> Column:
    return F.when(storable_seconds(seconds), F.timestamp_seconds(seconds))


def seconds_to_date(seconds: Column) -> Column:
    """The UTC day, whatever the session time zone is."""
    days = F.floor(seconds / F.lit(86400)).cast("int")
    return F.when(storable_seconds(seconds), F.date_add(F.lit("1970-01-01").cast("date"), days))


def timestamp_to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def millis_to_timestamp(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def ntz_to_seconds(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp read as UTC, in any session zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
