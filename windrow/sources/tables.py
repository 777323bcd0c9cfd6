"""Readings made from the driver tables, with an order key that is unique per row."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_ORDER = ["ts", "event_id"]
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Prefix of the device ids made from a number.
DEVICE_PREFIX = "00000000-0000-4000-8000-"


def use_utc(spark: SparkSession) -> None:
    """Zone-less times of the tables are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def device_id(number):
    return F.concat(F.lit(DEVICE_PREFIX), F.lpad(F.lower(F.hex(number)), 12, "0"))


def _measurements(power, rotor, wind):
    return F.struct(
        power.cast("double").alias("power"),
        rotor.cast("double").alias("rotorSpeed"),
        wind.cast("double").alias("windSpeed"),
    ).alias("measurements")


def _to_millis(ts):
    return F.date_trunc("millisecond", ts.cast("timestamp")).alias("timestamp")


def sensor_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per event; about a third of the wind speeds are negative."""
    events = load(spark, sf_dir, "events")
    return events.select(
        *EVENT_ORDER,
        device_id(F.col("user_id")).alias("deviceId"),
        _to_millis(F.col("ts")),
        _measurements(
            F.col("value"), F.get_json_object("props", "$.k"), F.col("value") - 20
        ),
    )


def sensor_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per line item, for volume."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.select(
        *LINEITEM_ORDER,
        device_id(F.col("l_suppkey")).alias("deviceId"),
        _to_millis(F.col("l_shipdate")),
        _measurements(
            F.col("l_quantity"), F.col("l_extendedprice") / 100, F.col("l_discount") - 0.05
        ),
    )


def balances(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Account balances of customers or suppliers as metrics; some are really negative."""
    letter = table[0]
    accounts = load(spark, sf_dir, table)
    key = "custkey" if letter == "c" else "suppkey"
    return accounts.select(
        device_id(F.col(f"{letter}_{key}")).alias("deviceId"),
        F.timestamp_millis(F.lit(0)).alias("timestamp"),
        F.lit("balance").alias("name"),
        F.col(f"{letter}_acctbal").alias("value"),
    )
