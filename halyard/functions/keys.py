"""Column helpers that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def norm_key(c: Column) -> Column:
    """A key as it is compared: without blanks (U+0020) at both ends, in lower case."""
    return F.lower(F.trim(c))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's zone."""
    return F.unix_micros(c.cast("timestamp"))


def floor_div(c: Column, n: int) -> Column:
    """c div n rounded down, for negative c too."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


def utc_day(c: Column) -> Column:
    """The UTC day of a timestamp as a date, whatever the session's zone."""
    return F.date_from_unix_date(floor_div(micros(c), DAY_US).cast("int"))
