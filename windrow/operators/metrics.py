"""Flatten readings to metrics, validate them and route them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.validity import is_valid_value
from windrow.schemas import INVALID_MESSAGE, MEASUREMENT_NAMES, METRIC

_TAG = "is_valid"


def to_metrics(df: DataFrame, names=None, keep=()) -> DataFrame:
    """One row per reading and measurement, in the order power, rotorSpeed, windSpeed.

    ``names`` limits the measurements. The optimizer does not move a later filter on ``name`` below
    the expansion, so a caller that wants one metric should ask for it here; no expansion is then
    needed. ``keep`` names extra columns to carry along, such as an order key.
    """
    wanted = [n for n in MEASUREMENT_NAMES if names is None or n in names]
    unknown = set(names or ()) - set(MEASUREMENT_NAMES)
    if unknown or not wanted:
        raise ValueError(f"no such measurement: {sorted(unknown) or names}")
    if {"name", "value"} & set(keep):
        raise ValueError("columns to keep must not be called name or value")
    kept = list(dict.fromkeys(["deviceId", "timestamp", *keep]))
    flat = df.select(*kept, *[F.col(f"measurements.{n}").alias(n) for n in wanted])
    if len(wanted) == 1:
        return flat.select(
            *kept, F.lit(wanted[0]).alias("name"), F.col(wanted[0]).alias("value")
        )
    return flat.unpivot(kept, wanted, "name", "value")


def metrics_of(df: DataFrame, record: T.StructType, names=None, keep=()) -> DataFrame:
    """Metrics of decoded records: readings are flattened, and records that are metrics already stay as they are."""
    fields = METRIC.fieldNames()
    if record.fieldNames() != fields:
        return to_metrics(df, names, keep)
    kept = [c for c in dict.fromkeys(keep) if c not in fields]
    flat = df.select("deviceId", "timestamp", *kept, "name", "value")
    return flat if names is None else flat.filter(F.col("name").isin(*names))


def validate(df: DataFrame, rule: Column | None = None, message: str = INVALID_MESSAGE) -> DataFrame:
    """Tag each metric with ``is_valid`` and, where it is not, the ``error`` text."""
    if rule is None:
        ok = is_valid_value(F.col("value"))  # never NULL, and in a form that reaches the scan
    else:
        ok = F.coalesce(rule, F.lit(False))
    return df.withColumn(_TAG, ok).withColumn("error", F.when(~F.col(_TAG), F.lit(message)))


def valid_metrics(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col(_TAG)).drop(_TAG, "error")


def invalid_metrics(tagged: DataFrame) -> DataFrame:
    """Rows as ``{metric, error}``; columns beyond the metric pass through."""
    fields = METRIC.fieldNames()
    others = [c for c in tagged.columns if c not in (*fields, _TAG, "error")]
    return tagged.filter(~F.col(_TAG)).select(
        *others, F.struct(*fields).alias("metric"), F.col("error")
    )


def keep_metric(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("name") == name)


def validation_summary(tagged: DataFrame) -> DataFrame:
    """Metrics per name and validity."""
    return tagged.groupBy("name", _TAG).agg(F.count("*").alias("metrics"))
