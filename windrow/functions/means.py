"""Running mean, folded one value at a time."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def incremental_mean(values: Column) -> Column:
    """Mean of an array by ``mean += (x - mean) / i``.

    Not the same bits as sum divided by count, and NaN if an infinity is among the values.
    """
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(1).alias("i"))

    def step(acc, x):
        mean = acc["mean"] + (x - acc["mean"]) / acc["i"]
        return F.struct(mean.alias("mean"), (acc["i"] + 1).alias("i"))

    return F.aggregate(values, start, step, lambda acc: acc["mean"])
