"""Sources and sinks: options, frames, lines, synthetic rows, and the shared folder."""

import datetime as dt

import pytest
from helpers import plan_nodes
from pyspark.sql import functions as F

from windrow import storage
from windrow.operators.codecs import decode_json, to_sensor_json
from windrow.operators.count_windows import count_windows
from windrow.operators.metrics import to_metrics
from windrow.plans.pipeline import run_batch
from windrow.sinks.lines import average_lines, invalid_lines, valid_lines
from windrow.sinks.topics import kafka_frame, spread, topic_sink
from windrow.sources.ingest import ingest_json
from windrow.sources.synthetic import synthetic_readings
from windrow.sources.tables import EVENT_ORDER, sensor_from_events
from windrow.sources.topics import KAFKA_RECORD, kafka_options, kafka_source, record_lines, topic_source
from windrow.streaming.pipeline import averages, run_stream


def test_kafka_options():
    assert kafka_options("t", "h:1") == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "t",
        "startingOffsets": "earliest",
    }
    more = kafka_options("t", "h:1", group="g", batch_limit=5)
    assert more["kafka.group.id"] == "g" and more["maxOffsetsPerTrigger"] == "5"


def test_kafka_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_source(spark, "t", "h:1")


def test_record_lines(spark):
    at = dt.datetime(2020, 5, 17, 13, 4, 5, 60_000)
    rows = [
        (bytearray(k), bytearray(b"Message_1"), "demo", 0, i, at)
        for i, k in enumerate([b"\0\0\0\1", b"\xff\xff\xff\xff", b"\x7f\xff\xff\xff", b"\x80\0\0\0", b"\1"])
    ]
    got = record_lines(spark.createDataFrame(rows, KAFKA_RECORD)).sort("offset").collect()
    assert [r["key"] for r in got] == [1, -1, 2**31 - 1, -(2**31), None]
    assert got[0]["line"] == (
        "Received message: topic-partition=demo-0 offset=0 "
        "timestamp=13:04:05:060 UTC 17 May 2020 key=1 value=Message_1"
    )
    assert got[4]["line"].endswith("key=null value=Message_1")


def test_kafka_frame(spark):
    df = spark.createDataFrame([(1, "Message_1"), (-2, "Message_2")], "k int, payload string")
    assert [tuple(r) for r in kafka_frame(df).collect()] == [(None, b"Message_1"), (None, b"Message_2")]
    keyed = kafka_frame(df, key="k").collect()
    assert [tuple(r) for r in keyed] == [(b"\0\0\0\1", "Message_1"), (b"\xff\xff\xff\xfe", "Message_2")]
    # what the sink writes, the source reads
    back = kafka_frame(df, key="k").select(
        "key", F.col("value").cast("binary"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
        F.monotonically_increasing_id().alias("offset"), F.timestamp_millis(F.lit(0)).alias("timestamp"),
    )
    assert sorted((r["key"], r["value"]) for r in record_lines(back).collect()) == [(-2, "Message_2"), (1, "Message_1")]


def test_lines(spark):
    m = spark.sql("select 'd' deviceId, timestamp_millis(5) timestamp, 'power' name, 1.5d value union all select 'd', timestamp_millis(5), 'power', double('NaN')")
    assert [r["line"] for r in valid_lines(m).collect()] == [
        'Current metric is {"deviceId":"d","timestamp":5,"name":"power","value":1.5}',
        'Current metric is {"deviceId":"d","timestamp":5,"name":"power","value":null}',
    ]
    bad = m.select(F.struct("*").alias("metric"), F.lit("no").alias("error"))
    assert invalid_lines(bad).first()["line"] == (
        'Invalid metric detected! {"metric":{"deviceId":"d","timestamp":5,"name":"power","value":1.5},"error":"no"}'
    )
    infinite = m.limit(1).withColumn("value", F.explode(F.array(F.lit(float("inf")), F.lit(float("-inf")))))
    text = '{"deviceId":"d","timestamp":5,"name":"power","value":null}'
    assert [r["line"] for r in valid_lines(infinite).collect()] == [f"Current metric is {text}"] * 2
    bad = infinite.select(F.struct("*").alias("metric"), F.lit("no").alias("error"))
    assert [r["line"] for r in invalid_lines(bad).collect()] == [f'Invalid metric detected! {{"metric":{text},"error":"no"}}'] * 2
    assert average_lines(spark.sql("select 2.5d average")).first()["line"] == "Average rotorspeed is: 2.5"


def test_synthetic_is_the_same_for_any_number_of_tasks(spark):
    a = synthetic_readings(spark, 1000, seed=3, start_ms=10, interval_ms=100, partitions=1)
    b = synthetic_readings(spark, 1000, seed=3, start_ms=10, interval_ms=100, partitions=7)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.exceptAll(synthetic_readings(spark, 1000, seed=4, start_ms=10, interval_ms=100)).count() == 1000
    rows = a.collect()
    assert len({r["deviceId"] for r in rows}) == 1000
    assert all(r["deviceId"][14] == "4" and r["deviceId"][19] in "89ab" for r in rows)
    times = sorted(r["timestamp"] for r in rows)
    assert times[1] - times[0] == dt.timedelta(milliseconds=100)
    for name, end in (("power", 100), ("rotorSpeed", 200), ("windSpeed", 200)):
        values = [r["measurements"][name] for r in rows]
        assert 0 <= min(values) and max(values) < end and max(values) > end * 0.95
    assert "Exchange" not in plan_nodes(a)


def test_spread_ignores_keys(spark):
    one_key = spark.range(0, 1000, 1, 2).select(F.lit("a").alias("k"))
    sizes = spread(one_key, 4).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 2


def test_sink_needs_a_checkpoint(spark, tmp_path):
    path = str(tmp_path / "in")
    topic_sink(spark.range(3), path)
    topic_sink(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(ValueError):
        topic_sink(topic_source(spark, path, spark.range(1).schema), str(tmp_path / "out"))


def test_shared_folder_is_the_one_of_the_cluster(spark):
    assert storage.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def kafka_rows(spark, readings):
    """Readings as JSON in Kafka records, each an hour after it was measured."""
    return to_sensor_json(readings, "value").select(
        F.lit(None).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit("t").alias("topic"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        (F.col("ts").cast("timestamp") + F.expr("interval 1 hour")).alias("timestamp"),
    )


def test_kafka_records_go_through(spark, sf_dir, tmp_path):
    """The record's own time does not hide the time of the reading, also when rows are ordered by it."""
    readings = sensor_from_events(spark, sf_dir)
    records = kafka_rows(spark, readings)
    decoded = decode_json(records, "value")[0]
    assert decoded.columns == ["key", "topic", "partition", "offset", "record_timestamp", "deviceId", "timestamp", "measurements"]
    got = ingest_json(records, "value")
    late = got.filter(F.col("record_timestamp") - F.col("timestamp") >= F.expr("interval 1 hour"))
    assert late.count() == got.count() == readings.count()

    order = ["timestamp", "offset"]
    want = count_windows(to_metrics(readings, ["rotorSpeed"], EVENT_ORDER), order_by=EVENT_ORDER)
    batch = run_batch(records, "json", order_by=order, col="value")["averages"]
    assert sorted(batch.collect()) == sorted(want.collect())

    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    records.write.parquet(source)
    stream = topic_source(spark, source, records.schema)
    run_stream(stream, out=out, checkpoint=checkpoint, order_by=order, ingress="json", col="value")
    assert sorted(averages(spark, out, checkpoint).collect()) == sorted(want.collect())


def test_order_by_the_readings_own_time(spark, sf_dir):
    metrics = to_metrics(sensor_from_events(spark, sf_dir), keep=["timestamp", "event_id"])
    assert metrics.columns == ["deviceId", "timestamp", "event_id", "name", "value"]
    with pytest.raises(ValueError):
        to_metrics(sensor_from_events(spark, sf_dir), keep=["value"])


def test_unknown_ingress(spark):
    with pytest.raises(ValueError):
        run_batch(spark.sql("select 1 id, 'x' payload"), "xml", order_by=["id"])


@pytest.mark.parametrize("materialize", [True, False])
def test_batch_keeps_the_payload_of_rejects_only(spark, materialize):
    df = spark.createDataFrame([(1, "zz")], "id int, payload string")
    out = run_batch(df, "json", order_by=["id"], materialize=materialize)
    assert [tuple(r) for r in out["rejects"].select("id", "payload", "fault").collect()] == [(1, "zz", "not a JSON object")]
    assert out["averages"].count() == 0
