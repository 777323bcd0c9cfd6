"""Sensor readings as JSON text, with column expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.identifiers import normalize_uuid
from windrow.functions.instants import millis_in_range, millis_to_ts, ts_to_millis
from windrow.schemas import MEASUREMENT_NAMES

_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _schema(id_type: str, time_type: str, number_type: str) -> str:
    numbers = ",".join(f"{name}:{number_type}" for name in MEASUREMENT_NAMES)
    return f"struct<deviceId:{id_type},timestamp:{time_type},measurements:struct<{numbers}>>"


_PLAIN = _schema("string", "bigint", "double")
_TYPED = _schema("variant", "variant", "variant")
_EXACT_TIME = "struct<timestamp:decimal(38,18)>"


def _wrapped(text: Column, schema: str) -> Column:
    """Parse of ``[text]``.

    ``from_json`` stops reading after the first value. As the only element of an array, anything
    after the document is an error or a second element.
    """
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{schema}>", _OPTIONS)


def _closes_early(text: Column) -> Column:
    """True if a "]" after the document ended the array of ``_wrapped``, so that the rest went unread.

    Only texts that hold a "]" are looked at; they must also parse as the value of a key.
    """
    keyed = F.from_json(
        F.concat(F.lit('{"doc":'), text, F.lit("}")), "struct<doc:struct<deviceId:string>>", _OPTIONS
    )
    return F.when(F.instr(text, "]") > 0, keyed["doc"].isNull()).otherwise(F.lit(False))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_number(value: Column) -> Column:
    return _kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")


def _number(value: Column) -> Column:
    """A JSON number as double, an explicit null as NaN, all else (missing included) as NULL."""
    return F.when(_kind(value) == "VOID", F.lit(float("nan"))).when(
        _is_number(value), value.try_cast("double")
    )


def _in_digits(time: Column) -> Column:
    """Whether the digits of a JSON number must be looked at; else it is 0 or beyond any time.

    Numbers of very large exponents must not become decimals, which would write all their digits out.
    """
    size = F.abs(time.try_cast("double"))
    return _is_number(time) & (size >= 0.5) & (size < 1e19)


def _cut(time: Column, digits: Column) -> Column:
    """The whole part of a JSON number, cut toward zero; NULL beyond a bigint.

    A double would round the fraction up; ``digits`` has 18 of them after the point, the last one rounded.
    """
    small = _is_number(time) & (F.abs(time.try_cast("double")) < 0.5)
    return F.when(small, F.lit(0).cast("bigint")).when(_in_digits(time), digits.try_cast("bigint"))


def _parts(device: Column, millis: Column, numbers: list[Column]) -> Column:
    measured = [n.alias(name) for n, name in zip(numbers, MEASUREMENT_NAMES)]
    return F.struct(
        normalize_uuid(device).alias("deviceId"),
        millis.alias("millis"),
        F.struct(*measured).alias("measurements"),
    )


def with_parsed_reading(df: DataFrame, col: str, name: str) -> DataFrame:
    """Add STRUCT<deviceId, millis, measurements>; parts that are not as required are NULL.

    Well-formed readings take the plain parse. Only when a part of it is missing is the text
    parsed again with the JSON type of each part, to tell an explicit null (NaN) from a missing or
    wrongly typed value, and once more for the digits of a fractional time. Each step is a column of its own, so that
    no text is parsed twice by the same rule.
    """
    text = F.col(col)
    plain, typed, exact = F.col("_plain"), F.col("_typed"), F.col("_exact")
    plain_numbers = [plain["measurements"][part] for part in MEASUREMENT_NAMES]
    complete = plain["deviceId"].isNotNull() & plain["timestamp"].isNotNull()
    for number in plain_numbers:
        complete = complete & number.isNotNull()
    device = F.when(_kind(typed["deviceId"]) == "STRING", typed["deviceId"].try_cast("string"))
    millis = _cut(typed["timestamp"], exact["timestamp"])
    numbers = [_number(typed["measurements"][part]) for part in MEASUREMENT_NAMES]

    def only(listed: Column) -> Column:
        return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))

    return (
        df.withColumn("_listed", _wrapped(text, _PLAIN))
        .withColumn("_plain", only(F.col("_listed")))
        .withColumn("_complete", F.coalesce(complete, F.lit(False)))
        .withColumn("_listed", F.when(~F.col("_complete"), _wrapped(text, _TYPED)))
        .withColumn("_typed", only(F.col("_listed")))
        .withColumn("_listed", F.when(_in_digits(typed["timestamp"]), _wrapped(text, _EXACT_TIME)))
        .withColumn("_exact", only(F.col("_listed")))
        .withColumn(
            name,
            F.when(_closes_early(text), F.lit(None))
            .when(F.col("_complete"), _parts(plain["deviceId"], plain["timestamp"], plain_numbers))
            .when(typed.isNotNull(), _parts(device, millis, numbers)),
        )
        .drop("_listed", "_plain", "_complete", "_typed", "_exact")
    )


def reading_fault(parsed: Column) -> Column:
    """Why a parsed payload is no reading; NULL if it is one."""
    missing = F.lit(False)
    for name in MEASUREMENT_NAMES:
        missing = missing | parsed["measurements"][name].isNull()
    return (
        F.when(parsed.isNull(), "not a JSON object")
        .when(parsed["deviceId"].isNull(), "bad deviceId")
        .when(parsed["millis"].isNull() | ~millis_in_range(parsed["millis"]), "bad timestamp")
        .when(missing, "bad measurements")
    )


def reading_of(parsed: Column) -> Column:
    """The parsed parts as a sensor reading."""
    return F.struct(
        parsed["deviceId"].alias("deviceId"),
        millis_to_ts(parsed["millis"]).alias("timestamp"),
        parsed["measurements"].alias("measurements"),
    )


def json_number(value: Column) -> Column:
    """NULL for what JSON cannot write: NaN and both infinities."""
    return F.when(F.abs(value) < float("inf"), value)


def reading_json(device: Column, timestamp: Column, measurements: Column) -> Column:
    """JSON text of a reading. NaN is written as null; JSON has no infinity, so such a row gives NULL."""
    values = [measurements[name] for name in MEASUREMENT_NAMES]
    finite = F.lit(True)
    for value in values:
        finite = finite & (F.abs(value) != float("inf"))
    text = F.to_json(
        F.struct(
            device.alias("deviceId"),
            ts_to_millis(timestamp).alias("timestamp"),
            F.struct(
                *[json_number(v).alias(n) for v, n in zip(values, MEASUREMENT_NAMES)]
            ).alias("measurements"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.when(finite, text)


def metric_json(device: Column, timestamp: Column, name: Column, value: Column) -> Column:
    """JSON text of a metric, in the same style; an infinite value is null, as NaN is."""
    return F.to_json(
        F.struct(
            device.alias("deviceId"),
            ts_to_millis(timestamp).alias("timestamp"),
            name.alias("name"),
            json_number(value).alias("value"),
        ),
        {"ignoreNullFields": "false"},
    )
