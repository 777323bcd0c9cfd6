"""Instants as epoch milliseconds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark keeps microseconds in a long; milliseconds beyond this cannot be held.
MAX_MILLIS = (2**63 - 1) // 1000


def millis_in_range(millis: Column) -> Column:
    return millis.between(-MAX_MILLIS, MAX_MILLIS)


def millis_to_ts(millis: Column) -> Column:
    """TIMESTAMP of a whole number of epoch milliseconds, NULL if Spark cannot hold it."""
    return F.when(millis_in_range(millis), F.timestamp_millis(millis))


def ts_to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)
