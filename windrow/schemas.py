"""The four record schemas. No field of any record is nullable.

String fields that hold a UUID carry ``{"logical": "uuid"}`` in their metadata, so
that the codecs know to normalise them.
"""

from pyspark.sql import types as T

# Record and field names, in wire order.
_UUID = {"logical": "uuid"}

MEASUREMENTS = T.StructType(
    [
        T.StructField("power", T.DoubleType(), False),
        T.StructField("rotorSpeed", T.DoubleType(), False),
        T.StructField("windSpeed", T.DoubleType(), False),
    ]
)

SENSOR_DATA = T.StructType(
    [
        T.StructField("deviceId", T.StringType(), False, _UUID),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("measurements", MEASUREMENTS, False),
    ]
)

METRIC = T.StructType(
    [
        T.StructField("deviceId", T.StringType(), False, _UUID),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)

INVALID_METRIC = T.StructType(
    [
        T.StructField("metric", METRIC, False),
        T.StructField("error", T.StringType(), False),
    ]
)

MEASUREMENT_NAMES = ("power", "rotorSpeed", "windSpeed")
INVALID_MESSAGE = "All measurements must be positive numbers!"


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.StructField]]:
    """Leaf fields of a record in wire order, with their dotted path."""
    found = []
    for field in schema.fields:
        path = prefix + field.name
        if isinstance(field.dataType, T.StructType):
            found += leaves(field.dataType, path + ".")
        else:
            found.append((path, field))
    return found
