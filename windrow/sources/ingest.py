"""From payload rows to readings. Undecodable payloads are left out; ``split_decoded`` keeps them."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from windrow.operators.codecs import decode_avro, decode_json
from windrow.schemas import SENSOR_DATA


def ingest_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """Readings of payloads that hold one JSON document each, as text or as UTF-8 bytes."""
    return decode_json(df, col)[0]


def ingest_avro(
    df: DataFrame, col: str = "payload", schema: T.StructType = SENSOR_DATA
) -> DataFrame:
    """Records of payloads that hold one Avro body of ``schema`` each."""
    return decode_avro(df, col, schema)[0]
