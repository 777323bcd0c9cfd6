"""Synthetic readings of any number, made in parallel."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Exclusive upper end of the drawn integer, and its divisor.
DRAWS = {"power": (1000, 10), "rotorSpeed": (20000, 100), "windSpeed": (2000, 10)}
INTERVAL_MS = 1000


def _draw(seed: int, what: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(what), F.col("id"))


def _random_uuid(seed: int) -> Column:
    """Version 4 layout over two hashes of the row number."""
    text = F.lower(
        F.concat(
            F.lpad(F.hex(_draw(seed, "uuid-high")), 16, "0"),
            F.lpad(F.hex(_draw(seed, "uuid-low")), 16, "0"),
        )
    )
    variant = F.substring(F.lit("89ab"), (F.pmod(_draw(seed, "variant"), F.lit(4)) + 1).cast("int"), F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(text, 1, 8),
        F.substring(text, 9, 4),
        F.concat(F.lit("4"), F.substring(text, 14, 3)),
        F.concat(variant, F.substring(text, 18, 3)),
        F.substring(text, 21, 12),
    )


def synthetic_readings(
    spark: SparkSession,
    n: int,
    seed: int = 0,
    start_ms: int = 0,
    interval_ms: int = INTERVAL_MS,
    partitions: int | None = None,
) -> DataFrame:
    """``n`` readings, one per interval. Each depends on the seed and its number only, so the table
    is the same for any number of tasks and after any retry."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    values = [
        (F.pmod(_draw(seed, name), F.lit(end)) / divisor).alias(name)
        for name, (end, divisor) in DRAWS.items()
    ]
    return rows.select(
        "id",
        _random_uuid(seed).alias("deviceId"),
        F.timestamp_millis(F.lit(start_ms) + F.col("id") * interval_ms).alias("timestamp"),
        F.struct(*values).alias("measurements"),
    )
