"""Log lines of metrics and averages, as a table with one ``line`` per row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.json_text import json_number, metric_json

# The text before each record.
VALID_TEXT = "Current metric is "
INVALID_TEXT = "Invalid metric detected! "
AVERAGE_TEXT = "Average rotorspeed is: "


def valid_lines(df: DataFrame) -> DataFrame:
    text = metric_json(F.col("deviceId"), F.col("timestamp"), F.col("name"), F.col("value"))
    return df.select(F.concat(F.lit(VALID_TEXT), text).alias("line"))


def invalid_lines(df: DataFrame) -> DataFrame:
    metric = F.struct(
        F.col("metric.deviceId").alias("deviceId"),
        F.unix_millis("metric.timestamp").alias("timestamp"),
        F.col("metric.name").alias("name"),
        json_number(F.col("metric.value")).alias("value"),
    )
    text = F.to_json(
        F.struct(metric.alias("metric"), F.col("error")), {"ignoreNullFields": "false"}
    )
    return df.select(F.concat(F.lit(INVALID_TEXT), text).alias("line"))


def average_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(AVERAGE_TEXT), F.col("average").cast("string")).alias("line"))
