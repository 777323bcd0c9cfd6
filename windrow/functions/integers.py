"""Whole-number arithmetic that stays exact for every bigint."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column, n: int) -> Column:
    """Quotient rounded down, also for negative values."""
    rest = F.pmod(value, F.lit(n).cast("bigint"))
    return F.call_function("div", value - rest, F.lit(n).cast("bigint"))
