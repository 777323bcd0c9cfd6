"""Validity of a measured value."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid_value(value: Column) -> Column:
    """True for zero (of either sign) and above; false for NaN, which Spark orders last, and NULL.

    The bound is written as -0.0: Spark compares it as 0.0, but a Parquet reader to which the
    comparison is pushed down orders -0.0 below 0.0, and would skip row groups that hold only -0.0.
    """
    return value.isNotNull() & (value >= -0.0) & ~F.isnan(value)
