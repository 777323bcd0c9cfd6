"""Streams give the rows of the batch run, also over restarts and after failures."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators.codecs import decode_avro, encode_avro, to_sensor_json
from windrow.operators.count_windows import count_windows, demand_batches
from windrow.operators.metrics import to_metrics, valid_metrics, validate
from windrow.operators.positions import HOT_ROWS
from windrow.operators.quota import admit_quota, schedule_quota
from windrow.operators.targets import assign_targets
from windrow.plans.pipeline import INVALID, METRICS, READINGS, ROTOR, VALID, run_batch
from windrow.sinks.topics import topic_sink
from windrow.sources.tables import EVENT_ORDER, sensor_from_events
from windrow.sources.topics import topic_source
from windrow.storage import make_dir, write_part
from windrow.streaming import pipeline, windows
from windrow.streaming.admission import stream_admit_quota
from windrow.streaming.carry import last_carry, read_carry, write_carry
from windrow.streaming.change_log import read_changes
from windrow.streaming.pipeline import AVERAGES, REJECTS, ingest_stream, run_stream
from windrow.streaming.positions import (
    read_placed,
    stream_assign_targets,
    stream_demand_batches,
    stream_schedule_quota,
)
from windrow.streaming.windows import read_windows, stream_count_windows, stream_windows_per_key

UNEVEN = [1, 400, 7, 300, 3, 2, 287]  # rows per file


def write_files(df, path, sizes, first=0):
    """One file per size, in the order of the events, later files newer."""
    start = first
    for size in sizes:
        df.filter(F.col("event_id").between(start, start + size - 1)).coalesce(1).write.mode("append").parquet(path)
        start += size
    return start


@pytest.fixture(scope="module")
def readings(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("readings") / "table")
    sensor_from_events(spark, sf_dir).write.parquet(path)
    df = spark.read.parquet(path)
    assert df.count() == sum(UNEVEN)
    return df


@pytest.fixture(scope="module")
def wind(readings):
    return valid_metrics(validate(to_metrics(readings, ["windSpeed"], keep=EVENT_ORDER)))


def as_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


WINDOW = ["window", "rows", "average", "last_pos"]


@pytest.mark.parametrize("batch_limit", [1, 3])
def test_windows_over_uneven_batches(spark, wind, tmp_path, batch_limit):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    write_files(wind, source, UNEVEN)
    stream = topic_source(spark, source, wind.schema, batch_limit=batch_limit)
    stream_count_windows(stream, order_by=EVENT_ORDER, out=out, checkpoint=checkpoint).awaitTermination()
    for partial in (True, False):
        want = count_windows(wind, order_by=EVENT_ORDER, emit_partial=partial)
        got = read_windows(spark, out, checkpoint, emit_partial=partial)
        assert as_rows(got, *WINDOW) == as_rows(want, *WINDOW)


def test_windows_over_one_small_batch(spark, wind, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    few = wind.sort("event_id").limit(3)
    few.coalesce(1).write.parquet(source)
    stream = topic_source(spark, source, wind.schema)
    stream_count_windows(stream, order_by=EVENT_ORDER, out=out, checkpoint=checkpoint).awaitTermination()
    assert read_windows(spark, out, checkpoint, emit_partial=False).count() == 0
    want = count_windows(few, order_by=EVENT_ORDER)
    assert as_rows(read_windows(spark, out, checkpoint), *WINDOW) == as_rows(want, *WINDOW)


@pytest.mark.parametrize("moment", ["before", "after"])
def test_windows_after_a_failure(spark, wind, tmp_path, monkeypatch, moment):
    """The run dies at batch 3, before or after its state is written; the restart repeats it."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    write_files(wind, source, UNEVEN)
    real, whole = windows.write_carry, windows.window_batch

    def dies_before_carry(rows, carry, batch_id):
        if batch_id == 3:
            raise RuntimeError("lost")
        real(rows, carry, batch_id)

    def dies_after_all(batch, batch_id, **options):
        whole(batch, batch_id, **options)
        if batch_id == 3:
            raise RuntimeError("lost")

    def run():
        stream = topic_source(spark, source, wind.schema, batch_limit=1)
        stream_count_windows(stream, order_by=EVENT_ORDER, out=out, checkpoint=checkpoint).awaitTermination()

    with monkeypatch.context() as patch:
        if moment == "before":
            patch.setattr(windows, "write_carry", dies_before_carry)
        else:
            patch.setattr(windows, "window_batch", dies_after_all)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    want = count_windows(wind, order_by=EVENT_ORDER)
    assert as_rows(read_windows(spark, out, checkpoint), *WINDOW) == as_rows(want, *WINDOW)


def test_lost_state_is_an_error(spark, tmp_path):
    state = spark.createDataFrame([(5,)], "next_pos bigint")
    for batch in range(4):
        write_carry(state, str(tmp_path), batch)
    assert read_carry(spark, str(tmp_path), 3, state.schema).first() == (5,)
    assert read_carry(spark, str(tmp_path), 2, state.schema).first() == (5,)
    for lost in (1, 4):
        with pytest.raises(RuntimeError):
            read_carry(spark, str(tmp_path), lost, state.schema)


@pytest.mark.parametrize("hot_rows", [HOT_ROWS, 20])
def test_windows_per_key_with_hot_keys(spark, wind, tmp_path, hot_rows):
    """One device has a third of the rows, and one has no name."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    third = F.pmod("event_id", F.lit(3))
    wind = wind.withColumn(
        "deviceId", F.when(third == 0, "hot").when(third == 1, F.col("deviceId"))
    )
    write_files(wind, source, UNEVEN)
    stream = topic_source(spark, source, wind.schema, batch_limit=2)
    stream_count_windows(
        stream, order_by=EVENT_ORDER, out=out, checkpoint=checkpoint, key="deviceId", hot_rows=hot_rows
    ).awaitTermination()
    columns = ["device", *WINDOW]
    for partial in (True, False):
        want = count_windows(wind, order_by=EVENT_ORDER, key="deviceId", emit_partial=partial)
        got = read_windows(spark, out, checkpoint, emit_partial=partial)
        named = [df.withColumn("device", F.coalesce("deviceId", F.lit("none"))) for df in (got, want)]
        assert as_rows(named[0], *columns) == as_rows(named[1], *columns)


def test_positions_go_on_over_batches(spark, readings, tmp_path):
    """Batch numbers, targets and slots of a stream in uneven batches are those of the table."""
    source = str(tmp_path / "in")
    rows = readings.select(*EVENT_ORDER, "timestamp")
    write_files(rows, source, UNEVEN)
    hour, quota, targets = 3_600_000, 10, [7, 8, 9]
    runs = {
        "batches": (stream_demand_batches, {}, demand_batches(rows, order_by=EVENT_ORDER)),
        "targets": (stream_assign_targets, {"targets": targets}, assign_targets(rows, targets, order_by=EVENT_ORDER)),
        "slots": (
            stream_schedule_quota,
            {"window_ms": hour, "quota": quota},
            schedule_quota(rows, hour, quota, order_by=EVENT_ORDER),
        ),
    }
    for name, (start, options, want) in runs.items():
        out = str(tmp_path / name / "out")
        stream = topic_source(spark, source, rows.schema, batch_limit=2)
        start(stream, order_by=EVENT_ORDER, out=out, checkpoint=str(tmp_path / name / "checkpoint"), **options).awaitTermination()
        got = read_placed(spark, out)
        assert got.count() == want.count()
        assert got.exceptAll(want.select(*got.columns)).count() == 0, name


@pytest.mark.parametrize("late_windows", [None, 3])
def test_admission_goes_on_over_batches(spark, readings, tmp_path, late_windows):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    day, quota = 86_400_000, 25
    rows = readings.select(*EVENT_ORDER, "timestamp")
    write_files(rows, source, UNEVEN)
    stream = topic_source(spark, source, rows.schema, batch_limit=1)
    stream_admit_quota(
        stream, day, quota, order_by=EVENT_ORDER, out=out, checkpoint=checkpoint, late_windows=late_windows, hot_rows=30
    ).awaitTermination()
    want = admit_quota(rows, day, quota, order_by=EVENT_ORDER)
    got = read_placed(spark, out)
    assert got.count() == want.count() and want.filter("not admitted").count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    schema = T.StructType([T.StructField("window", T.LongType()), T.StructField("seen", T.LongType())])
    if late_windows:
        kept = last_carry(spark, f"{checkpoint}/carry").count()
    else:
        kept = read_changes(spark, f"{checkpoint}/carry/changes", None, schema, ["window"]).count()
    assert kept == (late_windows or want.select("window").distinct().count())


def test_rows_beyond_the_late_windows(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    batches = [[0, 0], [10, 9, 8], [0, 8, 9, 7]]  # window numbers
    for i, windows_ in enumerate(batches):
        rows = [(i * 10 + j, w) for j, w in enumerate(windows_)]
        df = spark.createDataFrame(rows, "id int, w bigint").select("id", F.timestamp_millis(F.col("w") * 1000).alias("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
    stream = topic_source(spark, source, df.schema, batch_limit=1)
    stream_admit_quota(
        stream, 1000, 1, order_by=["id"], out=out, checkpoint=checkpoint, late_windows=3
    ).awaitTermination()
    got = {r["id"]: r["admitted"] for r in read_placed(spark, out).collect()}
    assert got == {0: True, 1: False, 10: True, 11: True, 12: True, 20: False, 21: False, 22: False, 23: False}


def test_pipeline_after_a_failure(spark, readings, tmp_path, monkeypatch):
    """The fused dataflow dies in a batch when some of its topics are written."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    payloads = payload_table(readings, "avro")
    write_files(payloads, source, UNEVEN)

    def run():
        stream = topic_source(spark, source, payloads.schema, batch_limit=2)
        run_stream(stream, out=out, checkpoint=checkpoint, order_by=EVENT_ORDER)

    def lost(batch, batch_id, **options):
        if batch_id == 2:
            raise RuntimeError("lost")
        window_batch(batch, batch_id, **options)

    window_batch = pipeline.window_batch
    with monkeypatch.context() as patch:
        patch.setattr(pipeline, "window_batch", lost)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    want = run_batch(payloads, "avro", order_by=EVENT_ORDER)
    for topic in (READINGS, VALID, INVALID, ROTOR, REJECTS):
        got = pipeline.read_topic(spark, out, topic)
        assert got.count() == want[topic].count(), topic
        assert got.exceptAll(want[topic].select(*got.columns)).count() == 0, topic
    got = pipeline.averages(spark, out, checkpoint)
    assert as_rows(got, *WINDOW) == as_rows(want[AVERAGES], *WINDOW)


def test_windows_per_key(spark, wind, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    write_files(wind, source, UNEVEN)
    stream = topic_source(spark, source, wind.schema, batch_limit=2)
    keyed = stream_windows_per_key(stream, key="deviceId", order_by=EVENT_ORDER)
    query = keyed.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start(out).awaitTermination()
    want = count_windows(wind, order_by=EVENT_ORDER, key="deviceId", emit_partial=False)
    columns = ["deviceId", *WINDOW]
    assert as_rows(spark.read.parquet(out), *columns) == as_rows(want, *columns)


def test_fold_holds_infinity():
    import pandas as pd

    from windrow.streaming.keyed import fold_windows

    class State:
        exists = False

        def update(self, value):
            self.value = value

    state = State()
    pdf = pd.DataFrame({"id": [2, 1, 0], "value": [1.0, math.inf, 1.0], "null": [False] * 3})
    out = list(fold_windows(3, "k", ["id"], "value", "null")(("a",), [pdf], state))[0]
    assert math.isnan(out["average"][0]) and out["is_nan"][0] and state.value == (1, [])


def test_windows_per_key_in_the_hour_that_comes_twice(spark, tmp_path):
    """Times are compared as instants and leave Spark as numbers, not as local times."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    at = F.timestamp_seconds(F.lit(1729989000) + F.col("id") * 1200)  # 2024-10-27 00:30 UTC and on, clocks go back at 01:00
    rows = spark.range(0, 6, 1, 1).select(F.lit("a").alias("k"), at.alias("ts"), F.col("id").cast("double").alias("value"))
    rows.orderBy(F.desc("ts")).coalesce(1).write.parquet(source)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        keyed = stream_windows_per_key(topic_source(spark, source, rows.schema), 2, key="k", order_by=["ts"])
        topic_sink(keyed, out, checkpoint).awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    found = sorted(tuple(r) for r in spark.read.parquet(out).select("window", "rows", "average", "last_pos").collect())
    assert found == [(0, 2, 0.5, 1), (1, 2, 2.5, 3), (2, 2, 4.5, 5)]


def test_order_of_a_key():
    """Numbers without gaps take the short way, others the long one; rows that are equal stay as they are."""
    import pandas as pd

    from windrow.streaming.keyed import _in_order

    for a, want in (([2, 1, 2, 1], [3, 1, 2, 0]), ([2.0, None, 2.0, 1.0], [1, 3, 2, 0]), (["b", "a", "b", None], [3, 1, 2, 0])):
        rows = pd.DataFrame({"a": a, "b": [1, 1, 0, 0]})
        assert _in_order(rows, ["a", "b"]).tolist() == want
    assert _in_order(pd.DataFrame({"a": [1, 0, 1, 0]}, index=[9, 9, 3, 3]), ["a"]).tolist() == [1, 3, 0, 2]


BAD = "zz"


def payload_table(readings, ingress):
    encoded = to_sensor_json(readings) if ingress == "json" else encode_avro(readings)
    bad = F.lit(BAD) if ingress == "json" else F.lit(BAD).cast("binary")
    return encoded.withColumn("payload", F.when(F.col("event_id") % 10 == 3, bad).otherwise(F.col("payload")))


@pytest.mark.parametrize("ingress,materialize", [("json", False), ("avro", False), ("avro", True)])
def test_pipeline_equals_batch_over_restarts(spark, readings, tmp_path, ingress, materialize):
    """Files arrive between two runs; the second goes on where the first one stopped."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    payloads = payload_table(readings, ingress)

    def run():
        stream = topic_source(spark, source, payloads.schema, batch_limit=2)
        run_stream(stream, out=out, checkpoint=checkpoint, order_by=EVENT_ORDER, ingress=ingress, materialize=materialize)

    done = write_files(payloads, source, UNEVEN[:4])
    run()
    write_files(payloads, source, UNEVEN[4:], done)
    run()
    want = run_batch(payloads, ingress, order_by=EVENT_ORDER)
    topics = [READINGS, VALID, INVALID, ROTOR, REJECTS] + ([METRICS] if materialize else [])
    for topic in topics:
        got = pipeline.read_topic(spark, out, topic, materialize=materialize)
        assert got.count() == want[topic].count(), topic
        assert got.exceptAll(want[topic].select(*got.columns)).count() == 0, topic
    assert pipeline.read_topic(spark, out, REJECTS, materialize=materialize).count() == 100
    got = pipeline.averages(spark, out, checkpoint, materialize=materialize)
    assert as_rows(got, *WINDOW) == as_rows(want[AVERAGES], *WINDOW)


def test_steps_run_side_by_side(spark, readings, tmp_path):
    """With a clock as the trigger all steps run at the same time, and start before there is input."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    payloads = payload_table(readings, "avro")
    make_dir(spark, source)
    queries = run_stream(
        topic_source(spark, source, payloads.schema),
        out=out,
        checkpoint=checkpoint,
        order_by=EVENT_ORDER,
        materialize=True,
        trigger={"processingTime": "0 seconds"},
    )
    try:
        assert all(q.isActive for q in queries)
        payloads.coalesce(1).write.mode("append").parquet(source)
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    want = run_batch(payloads, "avro", order_by=EVENT_ORDER)
    for topic in (READINGS, METRICS, VALID, INVALID, ROTOR, REJECTS):
        got = spark.read.parquet(f"{out}/{topic}")
        assert got.exceptAll(want[topic].select(*got.columns)).count() == 0, topic
        assert got.count() == want[topic].count(), topic
    got = pipeline.averages(spark, out, checkpoint, materialize=True)
    assert as_rows(got, *WINDOW) == as_rows(want[AVERAGES], *WINDOW)


def test_limited_ingest(spark, readings, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    payloads = payload_table(readings, "avro")
    write_files(payloads, source, UNEVEN)
    query = ingest_stream(spark, source, payloads.schema, out=out, checkpoint=checkpoint, batch_limit=3)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    want = decode_avro(payloads)[0]
    got = spark.read.parquet(out)
    assert got.count() == want.count() == 900
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_limited_ingest_keeps_every_payload(spark, readings, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    body = F.col("payload")
    broken = F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 10 == 1, F.concat(body, F.unhex(F.lit("00")))).otherwise(body)
    payloads = payload_table(readings, "avro").withColumn("payload", broken)
    start = 0
    for sizes in (UNEVEN[:3], UNEVEN[3:]):  # stopped and started again
        start = write_files(payloads, source, sizes, start)
        ingest_stream(spark, source, payloads.schema, out=out, checkpoint=checkpoint, batch_limit=2).awaitTermination()
    kept, rejects = decode_avro(payloads)
    got, thrown = spark.read.parquet(out), spark.read.parquet(pipeline.rejects_of(out)).drop("batch")
    assert (got.count(), thrown.count()) == (kept.count(), rejects.count())
    assert got.count() + thrown.count() == payloads.count() and thrown.count() > 100
    assert kept.select(*got.columns).exceptAll(got).count() == 0
    assert rejects.select(*thrown.columns).exceptAll(thrown).count() == 0


def test_a_part_written_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    write_part(spark.range(5).repartition(3), out, "batch-0")
    write_part(spark.range(5, 9).coalesce(1), out, "batch-1")
    write_part(spark.range(4).coalesce(1), out, "batch-0")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_ingest_refuses_the_folder_of_a_file_sink(spark, readings, tmp_path):
    """Its readers follow the sink's log and would miss what is added beside it."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    payloads = payload_table(readings, "avro")
    write_files(payloads, source, [5])
    topic_sink(topic_source(spark, source, payloads.schema), out, checkpoint).awaitTermination()
    with pytest.raises(ValueError, match="file sink"):
        ingest_stream(spark, source, payloads.schema, out=out, checkpoint=checkpoint + "2")
