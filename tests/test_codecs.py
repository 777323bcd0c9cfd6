"""Edge payloads of both codecs, against hand-written expectations and a row-wise encoder."""

import datetime as dt
import math
import random
import struct

import pyarrow as pa
import pytest
from helpers import plan_nodes
from pyspark.sql import functions as F

from windrow.functions import avro_body
from windrow.functions.identifiers import normalize_uuid
from windrow.operators.codecs import (
    decode_avro,
    decode_json,
    encode_avro,
    reject_summary,
    tag_avro,
    tag_json,
    to_sensor_json,
)
from windrow.schemas import INVALID_METRIC, METRIC, SENSOR_DATA
from windrow.sources.ingest import ingest_json

ID = "c75cb448-df0e-4692-8e06-0321b7703992"
M = '{"power":1.7,"rotorSpeed":3.9,"windSpeed":105}'
GOOD = f'{{"deviceId":"{ID}","timestamp":1495545646279,"measurements":{M}}}'
MS = 1495545646279

KEPT = {
    "plain": (GOOD, (ID, MS, 1.7, 3.9, 105.0)),
    "blank around": (f"  {GOOD}\n ", (ID, MS, 1.7, 3.9, 105.0)),
    "extra key": (GOOD.replace('"measurements"', '"x":{"y":2},"measurements"'), (ID, MS, 1.7, 3.9, 105.0)),
    "extra array": (GOOD.replace('"measurements"', '"x":[1,[2]],"measurements"'), (ID, MS, 1.7, 3.9, 105.0)),
    "bracket in text": (GOOD.replace('"measurements"', '"x":"]","measurements"'), (ID, MS, 1.7, 3.9, 105.0)),
    "extra in measurements": (GOOD.replace('"power"', '"gust":"x","power"'), (ID, MS, 1.7, 3.9, 105.0)),
    "other order": (f'{{"measurements":{M},"timestamp":{MS},"deviceId":"{ID}"}}', (ID, MS, 1.7, 3.9, 105.0)),
    "several lines": (GOOD.replace(",", ",\n    ").replace("{", "{\r\n\t"), (ID, MS, 1.7, 3.9, 105.0)),
    "key twice": (GOOD.replace('"power":1.7', '"power":1.7,"power":2'), (ID, MS, 2.0, 3.9, 105.0)),
    "upper case": (GOOD.replace(ID, ID.upper()), (ID, MS, 1.7, 3.9, 105.0)),
    "short groups": (GOOD.replace(ID, "1-1-1-1-1"), ("00000001-0001-0001-0001-000000000001", MS, 1.7, 3.9, 105.0)),
    "fractional time": (GOOD.replace(str(MS), f"{MS}.9"), (ID, MS, 1.7, 3.9, 105.0)),
    "time just below the next": (GOOD.replace(str(MS), f"{MS}.9999996"), (ID, MS, 1.7, 3.9, 105.0)),
    "time with 40 digits after the point": (GOOD.replace(str(MS), f"{MS}." + "9" * 17 + "4" * 23), (ID, MS, 1.7, 3.9, 105.0)),
    "time just above -1": (GOOD.replace(str(MS), "-0.9999999"), (ID, 0, 1.7, 3.9, 105.0)),
    "time with fraction and exponent": (GOOD.replace(str(MS), "1.4955456462799999999996e12"), (ID, 1495545646279, 1.7, 3.9, 105.0)),
    "time with negative exponent": (GOOD.replace(str(MS), "-59999E-4"), (ID, -5, 1.7, 3.9, 105.0)),
    "time with far exponent": (GOOD.replace(str(MS), "9e-999999999"), (ID, 0, 1.7, 3.9, 105.0)),
    "zero with far exponent": (GOOD.replace(str(MS), "0.000e999999999"), (ID, 0, 1.7, 3.9, 105.0)),
    "time with zeros after the point": (GOOD.replace(str(MS), "0.00012e6"), (ID, 120, 1.7, 3.9, 105.0)),
    "negative fractional time": (GOOD.replace(str(MS), "-5.9"), (ID, -5, 1.7, 3.9, 105.0)),
    "time with exponent": (GOOD.replace(str(MS), "1e3"), (ID, 1000, 1.7, 3.9, 105.0)),
    "null power": (GOOD.replace("1.7", "null"), (ID, MS, math.nan, 3.9, 105.0)),
    "exponent": (GOOD.replace("105", "1e2"), (ID, MS, 1.7, 3.9, 100.0)),
    "negative": (GOOD.replace("105", "-0.5"), (ID, MS, 1.7, 3.9, -0.5)),
    "beyond double": (GOOD.replace("105", "1e999"), (ID, MS, 1.7, 3.9, math.inf)),
    "null and fractional time": (GOOD.replace("1.7", "null").replace(str(MS), f"{MS}.2"), (ID, MS, math.nan, 3.9, 105.0)),
}

REJECTED = {
    "id no uuid": (GOOD.replace(ID, "x"), "bad deviceId"),
    "id number": (GOOD.replace(f'"{ID}"', "7"), "bad deviceId"),
    "id null": (GOOD.replace(f'"{ID}"', "null"), "bad deviceId"),
    "id object": (GOOD.replace(f'"{ID}"', '{"a":1}'), "bad deviceId"),
    "id group too long": (GOOD.replace(ID, "c75cb4481-df0e-4692-8e06-0321b7703992"), "bad deviceId"),
    "id four groups": (GOOD.replace(ID, "c75cb448-df0e-4692-8e06"), "bad deviceId"),
    "other case of key": (GOOD.replace("deviceId", "DeviceId"), "bad deviceId"),
    "time as text": (GOOD.replace(str(MS), f'"{MS}"'), "bad timestamp"),
    "time missing": (GOOD.replace(f'"timestamp":{MS},', ""), "bad timestamp"),
    "time null": (GOOD.replace(str(MS), "null"), "bad timestamp"),
    "time true": (GOOD.replace(str(MS), "true"), "bad timestamp"),
    "time beyond range": (GOOD.replace(str(MS), "9223372036854776"), "bad timestamp"),
    "time 1e999999999": (GOOD.replace(str(MS), "1e999999999"), "bad timestamp"),
    "time 1e400": (GOOD.replace(str(MS), "1e400"), "bad timestamp"),
    "time as text with fraction": (GOOD.replace(str(MS), f'"{MS}.5"'), "bad timestamp"),
    "time far beyond range": (GOOD.replace(str(MS), "1e40"), "bad timestamp"),
    "power as text": (GOOD.replace("1.7", '"1.7"'), "bad measurements"),
    "power as NaN text": (GOOD.replace("1.7", '"NaN"'), "bad measurements"),
    "power true": (GOOD.replace("1.7", "true"), "bad measurements"),
    "power array": (GOOD.replace("1.7", "[1.7]"), "bad measurements"),
    "wind missing": (GOOD.replace(',"windSpeed":105', ""), "bad measurements"),
    "measurements null": (GOOD.replace(M, "null"), "bad measurements"),
    "measurements text": (GOOD.replace(M, '"m"'), "bad measurements"),
    "not json": ("not json", "not a JSON object"),
    "array": ("[1]", "not a JSON object"),
    "reading in array": (f"[{GOOD}]", "not a JSON object"),
    "empty": ("", "not a JSON object"),
    "null literal": ("null", "not a JSON object"),
    "null": (None, "not a JSON object"),
    "cut": (GOOD[:-1], "not a JSON object"),
    "text after": (GOOD + " x", "not a JSON object"),
    "brace after": (GOOD + "}", "not a JSON object"),
    "bracket after": (GOOD + "]", "not a JSON object"),
    "brackets after": (f"{GOOD}],[{GOOD}", "not a JSON object"),
    "second document": (GOOD + GOOD, "not a JSON object"),
    "second after comma": (f"{GOOD},{GOOD}", "not a JSON object"),
    "key after comma": (f'{GOOD},"a":1', "not a JSON object"),
    "single quotes": (GOOD.replace('"power"', "'power'"), "not a JSON object"),
    "bare NaN": (GOOD.replace("1.7", "NaN"), "not a JSON object"),
    "leading zero": (GOOD.replace("1.7", "01"), "not a JSON object"),
}


def _rows(df):
    return {
        r["case"]: (r["deviceId"], r["ms"], r["power"], r["rotorSpeed"], r["windSpeed"])
        for r in df.select(
            "case", "deviceId", F.unix_millis("timestamp").alias("ms"), "measurements.*"
        ).collect()
    }


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def _assert_same(got, want):
    assert got.keys() == want.keys()
    for case in want:
        assert all(_same(a, b) for a, b in zip(got[case], want[case])), (case, got[case])


def test_json_cases(spark):
    cases = [(c, p) for c, (p, _) in {**KEPT, **REJECTED}.items()]
    readings, rejects = decode_json(spark.createDataFrame(cases, "case string, payload string"))
    _assert_same(_rows(readings), {c: w for c, (_, w) in KEPT.items()})
    got = {r["case"]: (r["payload"], r["fault"]) for r in rejects.collect()}
    assert {c: got[c][1] for c in got} == {c: f for c, (_, f) in REJECTED.items()}
    assert all(got[c][0] == p for c, (p, _) in REJECTED.items())


def test_json_bytes(spark):
    df = spark.createDataFrame([("a", bytearray(GOOD.encode())), ("b", bytearray(b"\xff"))], "case string, payload binary")
    _assert_same(_rows(ingest_json(df)), {"a": KEPT["plain"][1]})


def test_json_roundtrip(spark):
    rows = [
        (i, ID, dt.datetime(2020, 1, 1, 0, 0, 0, 1000 * i), (float(i), -0.0, v))
        for i, v in enumerate([0.1, 1e300, -5e-324, math.nan, 105.0])
    ]
    df = spark.createDataFrame(rows, "case int, deviceId string, timestamp timestamp, measurements struct<power double, rotorSpeed double, windSpeed double>")
    text = to_sensor_json(df)
    assert text.columns == ["case", "payload"]
    back = decode_json(text)[0]
    assert back.schema["timestamp"].dataType == SENSOR_DATA["timestamp"].dataType
    _assert_same(_rows(back), _rows(df))
    assert '"windSpeed":null' in text.filter("case = 3").first()["payload"]


def test_json_has_no_infinity(spark):
    df = spark.sql(f"select '{ID}' deviceId, timestamp_millis(0) timestamp, named_struct('power', double('Infinity'), 'rotorSpeed', 1d, 'windSpeed', 2d) measurements")
    assert to_sensor_json(df).first()["payload"] is None


def test_uuid_forms(spark):
    cases = {
        ID: ID,
        ID.upper(): ID,
        "1-2-3-4-5": "00000001-0002-0003-0004-000000000005",
        "123456789-2-3-4-5": None,
        "1-2-3-4": None,
        "1-2-3-4-": None,
        "1--3-4-5": None,
        "g-2-3-4-5": None,
        "1-2-3-4-5-6": None,
        "": None,
        ID + "\n": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    got = {r[0]: r[1] for r in df.select("u", normalize_uuid(F.col("u"))).collect()}
    assert got == cases


def _varint(n):
    z = (n << 1) ^ (n >> 63)
    out = b""
    while True:
        z, low = z >> 7, z & 0x7F
        out += bytes([low | (0x80 if z else 0)])
        if not z:
            return out


def _body(uuid, ms, *values):
    text = uuid.encode()
    return _varint(len(text)) + text + _varint(ms) + struct.pack(f"<{len(values)}d", *values)


AVRO_KEPT = {
    "plain": (_body(ID, MS, 1.7, 3.9, 105.0), (ID, MS, 1.7, 3.9, 105.0)),
    "before 1970": (_body(ID, -MS, 1.7, 3.9, 105.0), (ID, -MS, 1.7, 3.9, 105.0)),
    "time 0": (_body(ID, 0, 1.7, 3.9, 105.0), (ID, 0, 1.7, 3.9, 105.0)),
    "time -1": (_body(ID, -1, 1.7, 3.9, 105.0), (ID, -1, 1.7, 3.9, 105.0)),
    "time 63": (_body(ID, 63, 1.7, 3.9, 105.0), (ID, 63, 1.7, 3.9, 105.0)),
    "time 64": (_body(ID, 64, 1.7, 3.9, 105.0), (ID, 64, 1.7, 3.9, 105.0)),
    "upper case": (_body(ID.upper(), MS, 1.7, 3.9, 105.0), (ID, MS, 1.7, 3.9, 105.0)),
    "short id": (_body("1-1-1-1-1", MS, 1.7, 3.9, 105.0), ("00000001-0001-0001-0001-000000000001", MS, 1.7, 3.9, 105.0)),
    "special values": (_body(ID, MS, math.nan, -math.inf, -0.0), (ID, MS, math.nan, -math.inf, -0.0)),
}
AVRO_REJECTED = {
    "null": (None, "null payload"),
    "empty": (b"", "truncated or malformed body"),
    "zz": (b"zz", "truncated or malformed body"),
    "cut": (_body(ID, MS, 1.7, 3.9, 105.0)[:-1], "truncated or malformed body"),
    "cut in id": (_body(ID, MS, 1.7, 3.9, 105.0)[:20], "truncated or malformed body"),
    "more": (_body(ID, MS, 1.7, 3.9, 105.0) + b"\0", "trailing bytes"),
    # one byte less of time and one byte too many: as long as a good body
    "shifted": (_body(ID, MS >> 7, 1.7, 3.9, 105.0) + b"\0", "trailing bytes"),
    "negative length": (_varint(-3) + b"abc" + _body(ID, MS, 1.0, 2.0, 3.0), "truncated or malformed body"),
    "endless varint": (b"\xff" * 80, "truncated or malformed body"),
    "huge length": (_varint(2**62) + b"abc", "truncated or malformed body"),
    "no uuid": (_body("x" * 36, MS, 1.7, 3.9, 105.0), "bad deviceId"),
    "no text": (_varint(2) + b"\xff\xfe" + _body("", MS, 1.7, 3.9, 105.0)[1:], "bad deviceId"),
    "time beyond range": (_body(ID, 2**62, 1.7, 3.9, 105.0), "bad timestamp"),
}


def test_avro_cases(spark):
    cases = {**AVRO_KEPT, **AVRO_REJECTED}
    rows = [(c, None if p is None else bytearray(p)) for c, (p, _) in cases.items()]
    df = spark.createDataFrame(rows, "case string, payload binary")
    readings, rejects = decode_avro(df)
    _assert_same(_rows(readings), {c: w for c, (_, w) in AVRO_KEPT.items()})
    got = {r["case"]: r["fault"] for r in rejects.collect()}
    assert got == {c: f for c, (_, f) in AVRO_REJECTED.items()}


def test_avro_bytes_match_row_encoder(spark):
    rows = [
        (i, ID, dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms), (float(i), -1.5, 2.25))
        for i, ms in enumerate([0, 1, -1, 63, 64, -64, -65, 8191, 8192, MS, -MS])
    ]
    df = spark.createDataFrame(rows, "case int, deviceId string, timestamp timestamp, measurements struct<power double, rotorSpeed double, windSpeed double>")
    got = {r["case"]: bytes(r["payload"]) for r in encode_avro(df).collect()}
    epoch = dt.datetime(1970, 1, 1)
    for i, uuid, ts, values in rows:
        assert got[i] == _body(uuid, (ts - epoch) // dt.timedelta(milliseconds=1), *values)
    _assert_same(_rows(decode_avro(encode_avro(df))[0]), _rows(df))


@pytest.mark.parametrize("schema", [METRIC, INVALID_METRIC])
def test_avro_other_records(spark, schema):
    names = ["power", "", "naïve ∑", "x" * 300]
    metrics = spark.createDataFrame(
        [(i, ID, dt.datetime(2020, 1, 1), n, i / 3) for i, n in enumerate(names)],
        "case int, deviceId string, timestamp timestamp, name string, value double",
    )
    if schema is INVALID_METRIC:
        metrics = metrics.select("case", F.struct(*METRIC.fieldNames()).alias("metric"), F.lit("é").alias("error"))
    back, rejects = decode_avro(encode_avro(metrics, schema=schema), schema=schema)
    assert sorted(back.collect()) == sorted(metrics.select(*back.columns).collect())
    assert rejects.count() == 0


@pytest.mark.parametrize("shape", ["even", "uneven"])
def test_avro_random_batches(shape):
    """Bodies of one length take a shorter way; both must read and write what a row-wise coder does."""
    kinds = avro_body.wire_kinds(SENSOR_DATA)
    rng = random.Random(shape)
    whole = "truncated or malformed body"
    for _ in range(300):
        rows = []
        for i in range(rng.randrange(1, 12)):
            text = "x" * (36 if shape == "even" else rng.randrange(200))
            ms = MS + i if shape == "even" else rng.choice([0, -1, 2**63 - 1, -(2**63), rng.randrange(-(2**63), 2**63)])
            rows.append((text, ms, rng.random(), -0.0, math.inf))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), *[pa.float64()] * 3])]
        bodies = [_body(*r) for r in rows]
        assert avro_body._encode(columns, kinds).to_pylist() == bodies
        want = [None] * len(rows)
        for i in rng.sample(range(len(rows)), rng.randrange(len(rows) + 1)):
            cut, more = rng.randrange(len(bodies[i])), bytes(rng.randrange(1, 9))
            bodies[i], want[i] = rng.choice(
                [(None, "null payload"), (bodies[i][:cut], whole), (bodies[i] + more, "trailing bytes")]
            )
        part = pa.array([None, *bodies, b"q"], pa.binary()).slice(1, len(rows))
        values, faults = avro_body._decode(part, kinds)
        assert faults.to_pylist() == want
        for i, row in enumerate(rows):
            if want[i] is None:
                assert (values[0][i].as_py().decode(), *[v[i].as_py() for v in values[1:]]) == row


def test_json_random_doubles(spark):
    """decode(encode(x)) = x for any finite double, bit for bit."""
    rng = random.Random(11)
    doubles = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(6_000)]
    doubles = [d for d in doubles if math.isfinite(d)][:5_400]
    rows = [(i, *doubles[3 * i : 3 * i + 3]) for i in range(len(doubles) // 3)]
    df = spark.createDataFrame(rows, "case int, power double, rotorSpeed double, windSpeed double").select(
        "case", F.lit(ID).alias("deviceId"), F.timestamp_millis(F.col("case") * 1_000_003 - 10**9).alias("timestamp"),
        F.struct("power", "rotorSpeed", "windSpeed").alias("measurements"),
    )
    back = _rows(decode_json(to_sensor_json(df))[0])
    assert back == _rows(df) and len(back) == len(rows)


def test_avro_null_field_gives_null_body(spark):
    df = spark.sql("select cast(null as string) deviceId, timestamp_millis(0) timestamp, named_struct('power', 1d, 'rotorSpeed', 1d, 'windSpeed', 2d) measurements")
    assert encode_avro(df).first()["payload"] is None


def test_empty_input(spark):
    assert decode_avro(spark.createDataFrame([], "payload binary"))[0].count() == 0
    assert decode_json(spark.createDataFrame([], "payload string"))[0].count() == 0


def test_nothing_is_lost(spark):
    rows = [(p,) for p, _ in {**KEPT, **REJECTED}.values()]
    summary = reject_summary(tag_json(spark.createDataFrame(rows, "payload string"))).collect()
    assert sum(r["payloads"] for r in summary) == len(rows)
    assert {r["outcome"]: r["payloads"] for r in summary}["kept"] == len(KEPT)
    avro = [(None if p is None else bytearray(p),) for p, _ in {**AVRO_KEPT, **AVRO_REJECTED}.values()]
    summary = reject_summary(tag_avro(spark.createDataFrame(avro, "payload binary"))).collect()
    assert sum(r["payloads"] for r in summary) == len(avro)


def test_json_plan_has_no_python_and_no_second_parse(spark, tmp_path):
    path = str(tmp_path / "payloads")
    spark.createDataFrame([(GOOD,)], "payload string").write.parquet(path)
    for df in decode_json(spark.read.parquet(path)):
        nodes = plan_nodes(df)
        assert not [n for n in nodes if "Python" in n or "Exchange" in n or n == "Filter"]


def test_avro_decodes_once(spark, tmp_path):
    path = str(tmp_path / "payloads")
    spark.createDataFrame([(bytearray(AVRO_KEPT["plain"][0]),)], "payload binary").write.parquet(path)
    for df in decode_avro(spark.read.parquet(path)):
        nodes = plan_nodes(df)
        assert [n for n in nodes if "Python" in n] == ["ArrowEvalPython"]
        assert "Exchange" not in nodes
