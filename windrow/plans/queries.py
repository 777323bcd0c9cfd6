"""One query per operator, each over whole driver tables: (spark, sf_dir) -> DataFrame.

Times come out as epoch milliseconds and bytes as hex, so that any SQL engine can compare them.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.identifiers import normalize_uuid
from windrow.functions.instants import millis_to_ts, ts_to_millis
from windrow.operators import codecs, metrics
from windrow.operators.count_windows import count_windows, demand_batches
from windrow.operators.quota import admit_quota, schedule_quota
from windrow.operators.targets import assign_targets, hits_per_target
from windrow.plans import pipeline
from windrow.schemas import METRIC
from windrow.sinks.lines import average_lines, invalid_lines, valid_lines
from windrow.sinks.topics import kafka_frame, key_bytes, route_sink, spread, topic_sink
from windrow.sources.ingest import ingest_avro, ingest_json
from windrow.sources.tables import (
    EVENT_ORDER,
    LINEITEM_ORDER,
    balances,
    load,
    sensor_from_events,
    sensor_from_lineitem,
)
from windrow.sources.topics import record_lines, topic_source, topic_table
from windrow.storage import new_path
from windrow.streaming import commit_log
from windrow.streaming import pipeline as stream_pipeline
from windrow.streaming.admission import stream_admit_quota
from windrow.streaming.positions import (
    read_placed,
    stream_assign_targets,
    stream_demand_batches,
    stream_schedule_quota,
)
from windrow.streaming.windows import open_windows, read_windows, stream_count_windows, stream_windows_per_key

HOUR_MS = 3_600_000
HOURLY_QUOTA = 10
HOURLY_DRAIN = 4
# Payloads per micro-batch.
DEMAND = 999
PORTS = [7000, 7001, 7002]


def _flat_metrics(df: DataFrame) -> DataFrame:
    return df.select("deviceId", ts_to_millis(F.col("timestamp")).alias("timestamp_ms"), "name", "value")


def _no_nan(value):
    return F.when(~F.isnan(value), value)


def _flat_readings(df: DataFrame) -> DataFrame:
    """NaN shows as NULL."""
    return df.select(
        "event_id",
        "deviceId",
        ts_to_millis(F.col("timestamp")).alias("timestamp_ms"),
        *[_no_nan(F.col(f"measurements.{n}")).alias(n) for n in ("power", "rotorSpeed", "windSpeed")],
    )


def _checked(spark: SparkSession, sf_dir: str, names=None, keep=()) -> DataFrame:
    return metrics.validate(metrics.to_metrics(sensor_from_events(spark, sf_dir), names, keep))


def _valid_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return metrics.valid_metrics(_checked(spark, sf_dir, [name], EVENT_ORDER))


# flatten, validate, route


def flatten_metrics(spark, sf_dir):
    return _flat_metrics(metrics.to_metrics(sensor_from_events(spark, sf_dir)))


def valid_metrics(spark, sf_dir):
    return _flat_metrics(metrics.valid_metrics(_checked(spark, sf_dir)))


def invalid_metrics(spark, sf_dir):
    invalid = metrics.invalid_metrics(_checked(spark, sf_dir))
    return invalid.select(
        F.col("metric.deviceId").alias("deviceId"),
        F.unix_millis("metric.timestamp").alias("timestamp_ms"),
        F.col("metric.name").alias("name"),
        F.col("metric.value").alias("value"),
        "error",
    )


def validation_summary(spark, sf_dir):
    return metrics.validation_summary(_checked(spark, sf_dir))


def routed_topics(spark, sf_dir):
    """Both topics as they are after one pass over the readings."""
    topics = route_sink(_checked(spark, sf_dir), new_path(spark, "routed"))
    valid, invalid = topics[0], topics[1].select("metric.*")
    both = [_flat_metrics(valid).withColumn("topic", F.lit(pipeline.VALID))]
    both.append(_flat_metrics(invalid).withColumn("topic", F.lit(pipeline.INVALID)))
    return reduce(DataFrame.unionByName, both)


def balance_validation(spark, sf_dir):
    tables = [balances(spark, sf_dir, t).withColumn("owner", F.lit(t)) for t in ("customer", "supplier")]
    tagged = metrics.validate(reduce(DataFrame.unionByName, tables))
    return tagged.select("owner", "deviceId", "value", "is_valid", "error")


def lineitem_validation_summary(spark, sf_dir):
    readings = sensor_from_lineitem(spark, sf_dir)
    return metrics.validation_summary(metrics.validate(metrics.to_metrics(readings)))


def rotor_speed(spark, sf_dir):
    valid = metrics.valid_metrics(_checked(spark, sf_dir))
    return _flat_metrics(metrics.keep_metric(valid, "rotorSpeed"))


# count windows


def rotor_window_avg(spark, sf_dir):
    windows = count_windows(_valid_of(spark, sf_dir, "rotorSpeed"), order_by=EVENT_ORDER)
    return windows.select("window", "rows", "average")


def rotor_window_avg_full_only(spark, sf_dir):
    rotor = _valid_of(spark, sf_dir, "rotorSpeed")
    return count_windows(rotor, order_by=EVENT_ORDER, emit_partial=False).select("window", "rows", "average")


def wind_window_avg(spark, sf_dir):
    windows = count_windows(_valid_of(spark, sf_dir, "windSpeed"), order_by=EVENT_ORDER)
    return windows.select("window", "rows", "average")


def wide_window_avg(spark, sf_dir):
    """More rows per window than are gathered in fixed columns."""
    windows = count_windows(_valid_of(spark, sf_dir, "windSpeed"), 60, order_by=EVENT_ORDER)
    return windows.select("window", "rows", "average")


def device_window_avg(spark, sf_dir):
    wind = _valid_of(spark, sf_dir, "windSpeed")
    return count_windows(wind, order_by=EVENT_ORDER, key="deviceId").drop("last_pos")


def window_commit_positions(spark, sf_dir):
    wind = _valid_of(spark, sf_dir, "windSpeed")
    return count_windows(wind, order_by=EVENT_ORDER).select("window", "last_pos")


def lineitem_rotor_window_avg(spark, sf_dir):
    readings = sensor_from_lineitem(spark, sf_dir)
    rotor = metrics.valid_metrics(
        metrics.validate(metrics.to_metrics(readings, ["rotorSpeed"], LINEITEM_ORDER))
    )
    return count_windows(rotor, order_by=LINEITEM_ORDER).select("window", "rows", "average")


def demand_batch_numbers(spark, sf_dir):
    readings = sensor_from_events(spark, sf_dir).select(*EVENT_ORDER)
    return demand_batches(readings, order_by=EVENT_ORDER).select("event_id", "pos", "batch", "asks_next")


# lines


def valid_line_table(spark, sf_dir):
    return valid_lines(metrics.valid_metrics(_checked(spark, sf_dir)))


def invalid_line_table(spark, sf_dir):
    return invalid_lines(metrics.invalid_metrics(_checked(spark, sf_dir)))


def average_line_table(spark, sf_dir):
    return average_lines(count_windows(_valid_of(spark, sf_dir, "windSpeed"), order_by=EVENT_ORDER))


# codecs: which fault a payload has is chosen by its rotor speed, a whole number


def _k():
    return F.col("k").cast("int")


def _json_payloads(spark, sf_dir):
    readings = sensor_from_events(spark, sf_dir).withColumn("k", F.col("measurements.rotorSpeed"))
    text = F.col("payload")
    return codecs.to_sensor_json(readings).withColumn(
        "payload",
        F.when(_k() == 1, F.concat(F.lit("not json "), text))
        .when(_k() == 2, F.expr("substring(payload, 1, length(payload) - 1)"))
        .when(_k() == 3, F.regexp_replace(text, r'"timestamp":(-?[0-9]+)', r'"timestamp":"$1"'))
        .when(_k() == 4, F.regexp_replace(text, r'"power":([^,}]+)', r'"power":"$1"'))
        .when(_k() == 5, F.regexp_replace(text, r',"windSpeed":[^,}]+', ""))
        .when(_k() == 6, F.regexp_replace(text, '"deviceId":"[^"]*"', '"deviceId":"x"'))
        .when(_k() == 7, F.regexp_replace(text, r'"power":[^,}]+', '"power":null'))
        .when(_k() == 8, F.regexp_replace(text, r'"timestamp":(-?[0-9]+)', r'"timestamp":$1.75'))
        .when(_k() == 9, F.regexp_replace(text, '"deviceId":"[^"]*"', '"deviceId":"A-B-C-D-E"'))
        .when(_k() == 10, F.concat(text, F.lit(" x")))
        .when(_k() == 11, F.regexp_replace(text, r'"timestamp":-?[0-9]+', '"timestamp":1e40'))
        .when(_k() == 12, F.concat(F.lit("["), text, F.lit("]")))
        .when(_k() == 13, F.regexp_replace(text, '"measurements":', '"extra":[1,{"a":"]"}],"measurements":'))
        .otherwise(text),
    ).drop("k")


def json_roundtrip(spark, sf_dir):
    readings = sensor_from_events(spark, sf_dir)
    return _flat_readings(ingest_json(codecs.to_sensor_json(readings)))


def json_ingest(spark, sf_dir):
    return _flat_readings(ingest_json(_json_payloads(spark, sf_dir)))


def json_rejects(spark, sf_dir):
    return codecs.decode_json(_json_payloads(spark, sf_dir))[1].select("event_id", "fault")


def json_number_times(spark, sf_dir):
    """Times written with fractions and exponents: cut by their digits, rejected beyond range."""
    readings = sensor_from_events(spark, sf_dir)
    time = r'"timestamp":(-?[0-9])([0-9]*)'
    power = F.length(F.regexp_extract("payload", time, 2)).cast("string")
    text, form = F.col("payload"), F.col("event_id") % 6
    payloads = codecs.to_sensor_json(readings).withColumn(
        "payload",
        F.when(form == 1, F.regexp_replace(text, time, r'"timestamp":$1$2.9999999996'))
        .when(form == 2, F.regexp_replace(text, F.lit(time), F.concat(F.lit(r'"timestamp":$1.$2\9999999996e'), power)))
        .when(form == 3, F.regexp_replace(text, time, '"timestamp":-0.9999999'))
        .when(form == 4, F.regexp_replace(text, time, '"timestamp":1e400'))
        .when(form == 5, F.regexp_replace(text, time, r'"timestamp":$1$2\0E-1'))
        .otherwise(text),
    )
    kept, rejects = codecs.decode_json(payloads)
    times = kept.select("event_id", ts_to_millis(F.col("timestamp")).alias("timestamp_ms"), F.lit(None).cast("string").alias("fault"))
    return times.unionByName(rejects.select("event_id", F.lit(None).cast("long").alias("timestamp_ms"), "fault"))


def _avro_payloads(spark, sf_dir):
    readings = sensor_from_events(spark, sf_dir).withColumn("k", F.col("measurements.rotorSpeed"))
    readings = readings.withColumn(
        "deviceId",
        F.when(_k() == 6, F.lit("x")).when(_k() == 9, F.lit("A-B-C-D-E")).otherwise(F.col("deviceId")),
    )
    body = F.col("payload")
    return codecs.encode_avro(readings).withColumn(
        "payload",
        F.when(_k() == 1, F.lit(None))
        .when(_k() == 2, F.expr("substring(payload, 1, length(payload) - 1)"))
        .when(_k() == 3, F.concat(body, F.unhex(F.lit("00"))))
        .when(_k() == 4, F.lit("zz").cast("binary"))
        .when(_k() == 5, F.lit("").cast("binary"))
        .otherwise(body),
    ).drop("k")


def avro_roundtrip(spark, sf_dir):
    return _flat_readings(ingest_avro(codecs.encode_avro(sensor_from_events(spark, sf_dir))))


def avro_ingest(spark, sf_dir):
    return _flat_readings(ingest_avro(_avro_payloads(spark, sf_dir)))


def avro_rejects(spark, sf_dir):
    return codecs.decode_avro(_avro_payloads(spark, sf_dir))[1].select("event_id", "fault")


def generic_ingest(spark, sf_dir):
    """Metrics, not readings, as Avro bodies."""
    flat = metrics.to_metrics(sensor_from_events(spark, sf_dir))
    return _flat_metrics(ingest_avro(codecs.encode_avro(flat, schema=METRIC), schema=METRIC))


def reject_summary(spark, sf_dir):
    json = codecs.reject_summary(codecs.tag_json(_json_payloads(spark, sf_dir)))
    avro = codecs.reject_summary(codecs.tag_avro(_avro_payloads(spark, sf_dir)))
    return json.withColumn("codec", F.lit("json")).unionByName(avro.withColumn("codec", F.lit("avro")))


def uuid_forms(spark, sf_dir):
    """Ids with short groups in upper case; those with a long first group are refused."""
    events = load(spark, sf_dir, "events")
    parts = [F.hex("event_id"), F.hex("user_id"), F.lit("a"), F.lit("0"), F.hex(F.col("event_id") * 1_000_003)]
    text = F.concat_ws("-", *parts)
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("123456789"), text)).otherwise(text)
    return events.select("event_id", normalize_uuid(text).alias("id"))


def millis_roundtrip(spark, sf_dir):
    """Milliseconds to time and back; those that no time can hold give NULL."""
    events = load(spark, sf_dir, "events")
    millis = ts_to_millis(F.col("ts").cast("timestamp")) * F.when(
        F.col("event_type") == "error", F.lit(10_000)
    ).otherwise(F.lit(-1))
    return events.select("event_id", ts_to_millis(millis_to_ts(millis)).alias("millis"))


# records, synthetic data, Kafka shape


def _kafka_records(spark, sf_dir):
    """Events as a Kafka source would deliver them."""
    events = load(spark, sf_dir, "events")
    return events.select(
        key_bytes(F.col("user_id")).alias("key"),
        F.col("props").cast("binary").alias("value"),
        F.lit("readings").alias("topic"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def record_line_table(spark, sf_dir):
    return record_lines(_kafka_records(spark, sf_dir))


def kafka_payload_frame(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return kafka_frame(events, "props").select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


def kafka_keyed_frame(spark, sf_dir):
    accounts = load(spark, sf_dir, "customer")
    keyed = accounts.withColumn("number", F.floor("c_acctbal").cast("int"))
    return kafka_frame(keyed, "c_name", "number").select(F.hex("key").alias("key_hex"), "value")


def _arrivals(spark, sf_dir):
    return sensor_from_events(spark, sf_dir).select(*EVENT_ORDER, "timestamp")


def quota_admitted(spark, sf_dir):
    flagged = admit_quota(_arrivals(spark, sf_dir), HOUR_MS, HOURLY_QUOTA, order_by=EVENT_ORDER)
    return flagged.select("event_id", "window", "admitted")


def quota_with_queue(spark, sf_dir):
    """Each hour grants what the queue leaves of its quota; so many rows of the queue are done in an hour."""
    flagged = admit_quota(_arrivals(spark, sf_dir), HOUR_MS, HOURLY_QUOTA, order_by=EVENT_ORDER, drain=HOURLY_DRAIN)
    return flagged.select("event_id", "window", "depth", "admitted")


def quota_schedule(spark, sf_dir):
    timed = schedule_quota(_arrivals(spark, sf_dir), HOUR_MS, HOURLY_QUOTA, order_by=EVENT_ORDER)
    return timed.select("event_id", "window", "slot")


def target_assignment(spark, sf_dir):
    return assign_targets(_arrivals(spark, sf_dir), PORTS, order_by=EVENT_ORDER).select("event_id", "target")


def target_hits(spark, sf_dir):
    placed = assign_targets(_arrivals(spark, sf_dir), PORTS, order_by=EVENT_ORDER)
    return hits_per_target(placed, [*PORTS, 7003])


def nation_hits(spark, sf_dir):
    """Customers per nation; the list of targets is itself a table."""
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("target"))
    customers = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("target"))
    return hits_per_target(customers, nations)


def spread_balance(spark, sf_dir):
    parts = 4
    events = load(spark, sf_dir, "events")
    # each input task deals its rows out in turn, so it adds at most one row of difference
    tasks = events.select(F.spark_partition_id().alias("task")).distinct().count()
    dealt = spread(events, parts)
    sizes = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows"))
    return sizes.agg(
        F.count("*").alias("partitions"),
        F.sum("rows").alias("rows"),
        (F.max("rows") - F.min("rows") <= tasks).alias("balanced"),
    )


# the whole dataflow


def _pipeline(spark, sf_dir):
    return pipeline.run_batch(_avro_payloads(spark, sf_dir), "avro", order_by=EVENT_ORDER)


def pipeline_counts(spark, sf_dir):
    outputs = _pipeline(spark, sf_dir)
    names = [pipeline.READINGS, pipeline.METRICS, pipeline.VALID, pipeline.INVALID, pipeline.ROTOR, "rejects", "averages"]
    counts = [
        outputs[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("topic"), "rows")
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


def pipeline_averages(spark, sf_dir):
    payloads = codecs.to_sensor_json(sensor_from_events(spark, sf_dir))
    outputs = pipeline.run_batch(payloads, "json", order_by=EVENT_ORDER)
    return outputs["averages"].select("window", "rows", "average")


def _metric_payloads(spark, sf_dir):
    """Metrics, not readings, as Avro bodies: every eleventh event has no number, and some are cut short."""
    flat = metrics.to_metrics(sensor_from_events(spark, sf_dir), keep=EVENT_ORDER)
    value = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    encoded = codecs.encode_avro(flat.withColumn("value", value), schema=METRIC)
    cut = F.expr("substring(payload, 1, 7)")
    return encoded.withColumn("payload", F.when(F.col("event_id") % 13 == 0, cut).otherwise(F.col("payload")))


def _generic_pipeline(spark, sf_dir):
    return pipeline.run_batch(_metric_payloads(spark, sf_dir), "generic", order_by=EVENT_ORDER, record=METRIC)


def generic_pipeline_counts(spark, sf_dir):
    """Rows per topic, and payloads per outcome, of the dataflow over metrics; NaN is not valid."""
    outputs = _generic_pipeline(spark, sf_dir)
    names = [pipeline.METRICS, pipeline.VALID, pipeline.INVALID, pipeline.ROTOR, "averages"]
    counts = [outputs[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("topic"), "rows") for name in names]
    return reduce(DataFrame.unionByName, counts, outputs["outcomes"].toDF("topic", "rows"))


def generic_pipeline_averages(spark, sf_dir):
    return _generic_pipeline(spark, sf_dir)["averages"].select("window", "rows", "average")


# streams: every run starts a topic, and most stop and go on while it grows


def _in_thirds(df: DataFrame, path: str):
    """Append ``df`` to a topic in three parts by time, pausing after each."""
    for part in _thirds(df):
        part.write.mode("append").parquet(path)
        yield


def _thirds(df: DataFrame):
    """``df`` in three parts by time; rows without a time are in the last."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = df.agg(F.min(micros), F.max(micros)).first()
    low, high = low or 0, high or 0
    edges = [low, low + (high - low) // 3, low + 2 * (high - low) // 3, high + 1]
    for start, end in zip(edges, edges[1:]):
        part = (micros >= start) & (micros < end)
        yield df.filter(part if end < edges[-1] else part | micros.isNull())


def _folders(spark, label):
    base = new_path(spark, label)
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def topic_roundtrip_stream(spark, sf_dir):
    """Valid metrics into a topic, through a stream into another."""
    source, out, checkpoint = _folders(spark, "roundtrip")
    valid = metrics.valid_metrics(_checked(spark, sf_dir))
    topic_sink(valid, source)
    topic_sink(topic_source(spark, source, valid.schema), out, checkpoint).awaitTermination()
    return _flat_metrics(topic_table(spark, out, valid.schema))


def _limited_ingest(spark, sf_dir):
    """The readings and the rejects of Avro payloads, two files at a time."""
    source, out, checkpoint = _folders(spark, "ingest")
    payloads = _avro_payloads(spark, sf_dir)
    topic_sink(spread(payloads, spark.sparkContext.defaultParallelism), source)
    stream_pipeline.ingest_stream(
        spark, source, payloads.schema, out=out, checkpoint=checkpoint, batch_limit=2
    ).awaitTermination()
    return spark.read.parquet(out), spark.read.parquet(stream_pipeline.rejects_of(out))


def limited_ingest_stream(spark, sf_dir):
    """Avro payloads, two files at a time."""
    return _flat_readings(_limited_ingest(spark, sf_dir)[0])


def limited_ingest_counts(spark, sf_dir):
    """Payloads per outcome of the same stream: those kept, and the rejects of each reason."""
    kept, rejects = _limited_ingest(spark, sf_dir)
    outcomes = kept.select(F.lit("kept").alias("outcome")).unionByName(rejects.select(F.col("fault").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("payloads"))


def demand_ingest_stream(spark, sf_dir):
    """What became of each payload, in micro-batches of exactly so many records while the topic grows."""
    topic, out, checkpoint = _folders(spark, "demand-ingest")
    payloads = _avro_payloads(spark, sf_dir)
    for k, part in enumerate(_thirds(payloads)):
        # the files of a sorted batch are in its order
        commit_log.publish(part.sort(*EVENT_ORDER), topic, k)
        stream_pipeline.ingest_records(
            spark, topic, payloads.schema, out=out, checkpoint=checkpoint, records=DEMAND, ended=k == 2
        )
    kept = commit_log.published(spark, out).select("event_id", "place", F.lit("kept").alias("outcome"))
    rejects = commit_log.published(spark, stream_pipeline.rejects_of(out))
    outcomes = kept.unionByName(rejects.select("event_id", "place", F.col("fault").alias("outcome")))
    return outcomes.select("event_id", F.expr(f"place div {DEMAND}").alias("batch"), "outcome")


def followed_topic_stream(spark, sf_dir):
    """What a second stream read from the valid topic of the dataflow while it was written, and published on."""
    source, out, checkpoint = _folders(spark, "followed")
    payloads = _avro_payloads(spark, sf_dir)
    seen = new_path(spark, "followed-seen")
    for _ in _in_thirds(payloads, source):
        stream = topic_source(spark, source, payloads.schema)
        stream_pipeline.run_stream(stream, out=out, checkpoint=checkpoint, order_by=EVENT_ORDER)
        topic = f"{out}/{pipeline.VALID}"
        schema = commit_log.published(spark, topic).schema
        commit_log.follow(
            spark, topic, schema, lambda rows, k: commit_log.publish(rows, seen, k), checkpoint=f"{checkpoint}-second", batch_limit=1
        ).awaitTermination()
    return _flat_metrics(commit_log.published(spark, seen))


def _run_in_thirds(spark, sf_dir, label, materialize, **options):
    source, out, checkpoint = _folders(spark, label)
    payloads = _avro_payloads(spark, sf_dir)
    for _ in _in_thirds(payloads, source):
        stream_pipeline.run_stream(
            topic_source(spark, source, payloads.schema),
            out=out,
            checkpoint=checkpoint,
            order_by=EVENT_ORDER,
            materialize=materialize,
            **options,
        )
    return out, checkpoint


def fanout_stream(spark, sf_dir):
    """What each consumer of the valid topic saw."""
    out, _ = _run_in_thirds(spark, sf_dir, "fanout", False)
    seen = [
        _flat_metrics(stream_pipeline.read_topic(spark, out, topic)).withColumn("topic", F.lit(topic))
        for topic in (pipeline.VALID, pipeline.ROTOR)
    ]
    return reduce(DataFrame.unionByName, seen)


def resume_stream(spark, sf_dir):
    """Averages of a stream that was stopped and started again twice."""
    out, checkpoint = _run_in_thirds(spark, sf_dir, "resume", False)
    return stream_pipeline.averages(spark, out, checkpoint).select("window", "rows", "average")


def outcome_counts_stream(spark, sf_dir):
    """Payloads per outcome of the dataflow, counted in the pass that writes the rejects."""
    out, _ = _run_in_thirds(spark, sf_dir, "outcomes", False)
    return stream_pipeline.payload_outcomes(spark, out)


def line_topics_stream(spark, sf_dir):
    """The log lines of the dataflow on a stream."""
    out, _ = _run_in_thirds(spark, sf_dir, "lines", False, lines=True)
    topics = (stream_pipeline.VALID_LINES, stream_pipeline.INVALID_LINES)
    return reduce(DataFrame.unionByName, [stream_pipeline.read_topic(spark, out, topic) for topic in topics])


def chained_stream_counts(spark, sf_dir):
    """Rows per topic when each step is a query of its own."""
    out, checkpoint = _run_in_thirds(spark, sf_dir, "chained", True)
    topics = [pipeline.READINGS, pipeline.METRICS, pipeline.VALID, pipeline.INVALID, pipeline.ROTOR, "rejects"]
    tables = {t: spark.read.parquet(f"{out}/{t}") for t in topics}
    tables["averages"] = stream_pipeline.averages(spark, out, checkpoint, materialize=True)
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("topic"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def stream_window_avg(spark, sf_dir):
    source, out, checkpoint = _folders(spark, "windows")
    wind = _valid_of(spark, sf_dir, "windSpeed")
    for _ in _in_thirds(wind, source):
        stream_count_windows(
            topic_source(spark, source, wind.schema), order_by=EVENT_ORDER, out=out, checkpoint=checkpoint
        ).awaitTermination()
    return read_windows(spark, out, checkpoint).select("window", "rows", "average")


def _placed_in_thirds(spark, sf_dir, label, start, **options):
    source, out, checkpoint = _folders(spark, label)
    rows = _arrivals(spark, sf_dir)
    for _ in _in_thirds(rows, source):
        stream = topic_source(spark, source, rows.schema)
        start(stream, order_by=EVENT_ORDER, out=out, checkpoint=checkpoint, **options).awaitTermination()
    return read_placed(spark, out)


def demand_batches_stream(spark, sf_dir):
    placed = _placed_in_thirds(spark, sf_dir, "stream-batches", stream_demand_batches)
    return placed.select("event_id", "pos", "batch", "asks_next")


def admit_quota_stream(spark, sf_dir):
    placed = _placed_in_thirds(
        spark, sf_dir, "stream-quota", stream_admit_quota, window_ms=HOUR_MS, quota=HOURLY_QUOTA
    )
    return placed.select("event_id", "window", "admitted")


def schedule_quota_stream(spark, sf_dir):
    placed = _placed_in_thirds(
        spark, sf_dir, "stream-slots", stream_schedule_quota, window_ms=HOUR_MS, quota=HOURLY_QUOTA
    )
    return placed.select("event_id", "window", "slot")


def target_hits_stream(spark, sf_dir):
    """Hits per target of a stream, every target listed."""
    placed = _placed_in_thirds(spark, sf_dir, "stream-targets", stream_assign_targets, targets=PORTS)
    return hits_per_target(placed, [*PORTS, 7003])


def device_stream_all_windows(spark, sf_dir):
    """Windows per device, the open ones too, with hot devices divided over tasks."""
    source, out, checkpoint = _folders(spark, "device-all-windows")
    wind = _valid_of(spark, sf_dir, "windSpeed")
    for _ in _in_thirds(wind, source):
        stream = topic_source(spark, source, wind.schema)
        stream_count_windows(
            stream, order_by=EVENT_ORDER, out=out, checkpoint=checkpoint, key="deviceId"
        ).awaitTermination()
    return read_windows(spark, out, checkpoint).drop("last_pos")


def _device_windows_on_store(spark, sf_dir, label):
    source, out, checkpoint = _folders(spark, label)
    wind = _valid_of(spark, sf_dir, "windSpeed")
    for _ in _in_thirds(wind, source):
        stream = topic_source(spark, source, wind.schema, batch_limit=1_000)
        windows = stream_windows_per_key(stream, key="deviceId", order_by=EVENT_ORDER)
        topic_sink(windows, out, checkpoint).awaitTermination()
    return spark.read.parquet(out), checkpoint


def device_stream_window_avg(spark, sf_dir):
    """Full windows per device; open ones stay in the state."""
    return _device_windows_on_store(spark, sf_dir, "device-windows")[0].drop("last_pos")


def device_stream_every_window(spark, sf_dir):
    """All windows of the same stream, stopped and started twice: the full ones, and the open ones out of the state store."""
    full, checkpoint = _device_windows_on_store(spark, sf_dir, "device-every-window")
    return full.unionByName(open_windows(spark, checkpoint, key="deviceId"))
