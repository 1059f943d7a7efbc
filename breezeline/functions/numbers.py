"""Conversions with the number rules of the JVM's own casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2147483647
INT_MIN = -2147483648


def truncated_int(value: Column) -> Column:
    """Double to int toward zero: NaN is 0, what does not fit is clipped."""
    return (
        F.when(F.isnan(value), F.lit(0))
        .when(value >= F.lit(float(INT_MAX)), F.lit(INT_MAX))
        .when(value <= F.lit(float(INT_MIN)), F.lit(INT_MIN))
        .otherwise(value.cast("int"))
    )


def percent_increase(value: Column, base: Column) -> Column:
    """Whole percent by which value exceeds base; a zero base gives INT_MAX."""
    return F.when(base == 0, F.lit(INT_MAX)).otherwise(
        truncated_int((value - base) / base * F.lit(100))
    )


def wrapped_int(value: Column) -> Column:
    """The low 32 bits of a long, as a signed int."""
    return F.shiftright(F.shiftleft(value, 32), 32).cast("int")


def json_number(value: Column) -> Column:
    """The number, or NULL for NaN, which JSON cannot write as a number."""
    return F.when(~F.isnan(value), value)
