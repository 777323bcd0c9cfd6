"""Headline timings, one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.

Each query is run twice on a warm session and the faster run counts. Results are computed in full
(every column of every row) and thrown away. Payload tables are written before the clock starts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2


def session():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("windrow-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    spark = session()
    from windrow.operators import codecs, metrics
    from windrow.operators.count_windows import count_windows
    from windrow.plans import queries as q
    from windrow.plans.pipeline import INVALID, VALID, run_batch
    from windrow.sources.tables import EVENT_ORDER, LINEITEM_ORDER, sensor_from_events, sensor_from_lineitem
    from windrow.sources.topics import topic_source
    from windrow.storage import new_path
    from windrow.streaming.pipeline import run_stream

    base = new_path(spark, "bench")

    def discard(*tables):
        for table in tables:
            table.write.format("noop").mode("overwrite").save()

    readings = sensor_from_lineitem(spark, SF_DIR)
    n_readings, n_events = readings.count(), sensor_from_events(spark, SF_DIR).count()
    codecs.to_sensor_json(readings).repartition(int(CPUS)).write.parquet(f"{base}/json")
    codecs.encode_avro(readings).repartition(int(CPUS)).write.parquet(f"{base}/avro")
    bodies = codecs.encode_avro(sensor_from_events(spark, SF_DIR))
    bodies.repartitionByRange(12, *EVENT_ORDER).write.parquet(f"{base}/topic")
    runs = iter(range(10_000))

    def flatten_validate_split():
        tagged = metrics.validate(metrics.to_metrics(readings))
        discard(metrics.valid_metrics(tagged), metrics.invalid_metrics(tagged))

    def decoded(kind):
        payloads = spark.read.parquet(f"{base}/{kind}")
        return (codecs.decode_json if kind == "json" else codecs.decode_avro)(payloads)[0]

    def end_to_end(kind):
        """From payloads to averages, with the topics in between."""
        payloads = spark.read.parquet(f"{base}/{kind}")
        topics = run_batch(payloads, kind, order_by=LINEITEM_ORDER)
        discard(topics[VALID], topics[INVALID], topics["averages"])

    def windows(**options):
        rotor = metrics.to_metrics(readings, ["rotorSpeed"], LINEITEM_ORDER)
        discard(count_windows(rotor, order_by=LINEITEM_ORDER, **options))

    def stream(batch_limit):
        run = f"{base}/run-{next(runs)}"
        payloads = topic_source(spark, f"{base}/topic", bodies.schema, batch_limit=batch_limit)
        run_stream(payloads, out=f"{run}/out", checkpoint=f"{run}/checkpoint", order_by=EVENT_ORDER)

    work = {
        "flatten_validate_split": (flatten_validate_split, n_readings),
        "validation_summary": (lambda: discard(q.lineitem_validation_summary(spark, SF_DIR)), n_readings),
        "json_encode": (lambda: discard(codecs.to_sensor_json(readings)), n_readings),
        "json_decode": (lambda: discard(decoded("json")), n_readings),
        "json_end_to_end": (lambda: end_to_end("json"), n_readings),
        "avro_encode": (lambda: discard(codecs.encode_avro(readings)), n_readings),
        "avro_decode": (lambda: discard(decoded("avro")), n_readings),
        "avro_end_to_end": (lambda: end_to_end("avro"), n_readings),
        "count_window_avg": (windows, n_readings),
        "device_window_avg": (lambda: windows(key="deviceId"), n_readings),
        "demand_batches": (lambda: discard(q.demand_batch_numbers(spark, SF_DIR)), n_events),
        "admit_quota": (lambda: discard(q.quota_admitted(spark, SF_DIR)), n_events),
        "schedule_quota": (lambda: discard(q.quota_schedule(spark, SF_DIR)), n_events),
        "hits_per_target": (lambda: discard(q.target_hits(spark, SF_DIR)), n_events),
        "stream_all_at_once": (lambda: stream(None), n_events),
        "stream_4_files": (lambda: stream(4), n_events),
    }
    only = sys.argv[1:]
    seconds, rates = {}, {}
    for name, (run, rows) in work.items():
        if only and name not in only:
            continue
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - start)
        seconds[name], rates[name] = round(best, 3), round(rows / best)
        print(f"{name}: {best:.3f} s, {rates[name]} input rows/s", file=sys.stderr, flush=True)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "input_rows_per_sec": rates,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
