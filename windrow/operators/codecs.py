"""Codecs as jobs over whole payload tables or streams.

``tag_*`` keeps every payload row and adds ``reading`` (the record, NULL if undecodable) and
``fault`` (why). ``decode_*`` routes the tagged rows into readings and rejects.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.avro_body import body_decoder, body_encoder
from windrow.functions.identifiers import normalize_uuid
from windrow.functions.instants import millis_in_range, millis_to_ts, ts_to_millis
from windrow.functions.json_text import (
    reading_fault,
    reading_json,
    reading_of,
    with_parsed_reading,
)
from windrow.schemas import SENSOR_DATA, leaves

_ALL = "payloads"


# Why a payload is a reject, in the words of the two decoders; "bad <field>" of the fields checked comes to the second.
JSON_FAULTS = ("not a JSON object", "bad deviceId", "bad timestamp", "bad measurements")
AVRO_FAULTS = ("null payload", "truncated or malformed body", "trailing bytes")


def avro_faults(schema: T.StructType = SENSOR_DATA) -> tuple[str, ...]:
    checked = [f.name for _, f in leaves(schema) if isinstance(f.dataType, T.TimestampType) or _is_uuid(f)]
    return (*AVRO_FAULTS, *dict.fromkeys(f"bad {name}" for name in checked))


def _nested(schema: T.StructType, parts: dict[str, Column], prefix: str = "") -> Column:
    """A struct in the shape of ``schema`` from its leaf columns."""
    fields = []
    for field in schema.fields:
        path = prefix + field.name
        if isinstance(field.dataType, T.StructType):
            fields.append(_nested(field.dataType, parts, path + ".").alias(field.name))
        else:
            fields.append(parts[path].alias(field.name))
    return F.struct(*fields)


def _is_uuid(field: T.StructField) -> bool:
    return field.metadata.get("logical") == "uuid"


def to_sensor_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """Replace the reading columns by their JSON text; other columns pass through."""
    text = reading_json(F.col("deviceId"), F.col("timestamp"), F.col("measurements"))
    return df.withColumn(col, text).drop(*SENSOR_DATA.fieldNames())


def encode_avro(
    df: DataFrame, col: str = "payload", schema: T.StructType = SENSOR_DATA
) -> DataFrame:
    """Replace the record columns by the Avro body; other columns pass through."""
    inputs = []
    for path, field in leaves(schema):
        leaf = F.col(path)
        inputs.append(ts_to_millis(leaf) if isinstance(field.dataType, T.TimestampType) else leaf)
    return df.withColumn(col, body_encoder(schema)(*inputs)).drop(*schema.fieldNames())


def tag_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """Strict decode of JSON text or UTF-8 bytes: all fields required, unknown keys ignored."""
    if isinstance(df.schema[col].dataType, T.BinaryType):
        text = df.withColumn("_text", F.make_valid_utf8(F.col(col).cast("string")))
        parsed = with_parsed_reading(text, "_text", "_parsed").drop("_text")
    else:
        parsed = with_parsed_reading(df, col, "_parsed")
    tagged = parsed.withColumn("fault", reading_fault(F.col("_parsed")))
    reading = F.when(F.col("fault").isNull(), reading_of(F.col("_parsed")))
    return tagged.withColumn("reading", reading).drop("_parsed")


def tag_avro(
    df: DataFrame, col: str = "payload", schema: T.StructType = SENSOR_DATA
) -> DataFrame:
    """Decode of Avro bodies of any of the record schemas. A body must end where its record ends."""
    parsed = df.withColumn("_body", body_decoder(schema)(F.col(col)))
    fault = F.col("_body")["fault"]
    checks = F.when(fault.isNotNull(), fault)
    parts = {}
    for i, (path, field) in enumerate(leaves(schema)):
        raw = F.col("_body")[f"f{i}"]
        if isinstance(field.dataType, T.TimestampType):
            checks = checks.when(~millis_in_range(raw), f"bad {field.name}")
            raw = millis_to_ts(raw)
        elif _is_uuid(field):
            raw = normalize_uuid(F.make_valid_utf8(raw.cast("string")))
            checks = checks.when(raw.isNull(), f"bad {field.name}")
        elif isinstance(field.dataType, T.StringType):
            raw = F.make_valid_utf8(raw.cast("string"))
        parts[path] = raw
    tagged = parsed.withColumn("fault", checks)
    record = F.when(F.col("fault").isNull(), _nested(schema, parts))
    return tagged.withColumn("reading", record).drop("_body")


def carried_names(columns: list[str], schema: T.StructType = SENSOR_DATA) -> list[str]:
    """Names that columns of a payload table have beside the decoded record.

    One that is also a field of the record, as the time of a Kafka record, becomes ``record_...``.
    """
    return [f"record_{c}" if c in schema.fieldNames() else c for c in columns]


def split_decoded(tagged: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Readings (record columns plus pass-through columns) and rejects (raw payload, reason).

    Rows are dropped by ``inline`` rather than ``filter``: the optimizer would copy a filter, and
    the whole decode with it, below the decode and run it twice. Both results read ``tagged``; if
    both are used, materialise it first.
    """
    others = [c for c in tagged.columns if c not in (col, "reading", "fault")]
    names = carried_names(others, tagged.schema["reading"].dataType)
    beside = [F.col(c).alias(name) for c, name in zip(others, names)]
    whole = F.col("fault").isNull()
    kept = tagged.select(*beside, F.inline(F.when(whole, F.array("reading"))))
    rejects = tagged.select(*others, F.inline(F.when(~whole, F.array(F.struct(col, "fault")))))
    return kept, rejects


def decode_json(df: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    return split_decoded(tag_json(df, col), col)


def decode_avro(
    df: DataFrame, col: str = "payload", schema: T.StructType = SENSOR_DATA
) -> tuple[DataFrame, DataFrame]:
    return split_decoded(tag_avro(df, col, schema), col)


def observe_outcomes(tagged: DataFrame, faults: Iterable[str], seen: Observation) -> DataFrame:
    """The same rows; when they are written, ``seen`` counts the payloads per outcome on the way, without a job of its own.

    Write them (or what is selected of them, row by row) exactly once: the counts are those of that write. A task that is run
    again after a loss counts once as long as no shuffle lies between.
    """
    counts = [F.count(F.when(F.col("fault") == fault, 1)).alias(fault) for fault in dict.fromkeys(faults)]
    kept = F.count(F.when(F.col("fault").isNull(), 1)).alias("kept")
    return tagged.observe(seen, F.count("*").alias(_ALL), kept, *counts)


def observed_outcomes(seen: Observation) -> dict[str, int]:
    """What ``observe_outcomes`` has counted, outcomes with payloads only; unknown reasons are "other"."""
    counts = dict(seen.get)
    total = counts.pop(_ALL, 0)
    counts["other"] = total - sum(counts.values())
    return {outcome: n for outcome, n in counts.items() if n}


def reject_summary(tagged: DataFrame) -> DataFrame:
    """Payloads per outcome: kept, or the reason of the reject."""
    outcome = F.coalesce(F.col("fault"), F.lit("kept"))
    return tagged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("payloads"))
