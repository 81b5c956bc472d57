"""Column helpers that are safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column) -> Column:
    """x within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b within [0, 1]; 0 where b isn't positive."""
    return F.when(b > 0, clipped(F.try_divide(a.cast("double"), b.cast("double")))).otherwise(F.lit(0.0))


def squashed(x: Column) -> Column:
    """x / (x + 1) within [0, 1], for x >= 0."""
    return clipped(F.try_divide(x, x + 1.0))


def micros(column: Column, kind: str) -> Column:
    """Microseconds since 1970 (UTC) of a timestamp, date, or text; null where a text is none."""
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "string":
        return F.unix_micros(F.try_to_timestamp(column))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def from_micros(column: Column, kind: str) -> Column:
    """The inverse of micros(), as the type `kind` ("timestamp" or "timestamp_ntz")."""
    if kind == "timestamp":
        return F.timestamp_micros(column)
    return F.timestamp_add("MICROSECOND", column, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def finite(column: Column) -> Column:
    """The value as a double, with NaN as null."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def fixed(x: Column, decimals: int) -> Column:
    """x as text with so many decimals, rounded by its exact binary value, ties to even; engines else differ on halves."""
    scale = float(10**decimals)
    p = x * scale
    # the product's rounding error, by splitting x into two halves of its digits
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - p) + (x - high) * scale
    down = F.floor(p).cast("double")
    rest = p - down
    even = down % 2 == 0
    up = F.when(rest == 0.5, (error > 0) | ((error == 0) & ~even)).otherwise(rest > 0.5)
    return F.format_string(f"%.{decimals}f", F.when(up, down + 1).otherwise(down) / scale)
