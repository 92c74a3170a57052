"""Times as whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(at: Column, length: int) -> Column:
    """Number of the bucket a time lies in, by whole-number arithmetic, also before 1970."""
    whole = at - F.pmod(at, F.lit(length).cast("bigint"))
    return F.call_function("div", whole, F.lit(length).cast("bigint"))
