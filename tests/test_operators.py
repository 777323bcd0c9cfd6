"""Batch operators on small tables, against plain Python."""

import itertools
import math
import random

import pytest
from helpers import plan_nodes
from pyspark.sql import functions as F

from windrow.operators import positions
from windrow.operators.count_windows import count_windows, demand_batches
from windrow.operators.metrics import (
    invalid_metrics,
    keep_metric,
    to_metrics,
    valid_metrics,
    validate,
    validation_summary,
)
from windrow.operators.positions import rank_within, with_position
from windrow.operators.quota import admit_quota, schedule_quota
from windrow.operators.targets import assign_targets, hits_per_target
from windrow.schemas import INVALID_MESSAGE
from windrow.sinks.topics import route_sink
from windrow.sources.tables import EVENT_ORDER, sensor_from_events


def fold(values):
    mean = 0.0
    for i, v in enumerate(values, 1):
        mean = mean + (v - mean) / i
    return mean


def numbers(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "id int, value double")


def test_validation_edges(spark):
    values = [-1.0, -0.0, 0.0, math.inf, -math.inf, math.nan]
    tagged = validate(numbers(spark, values).withColumn("name", F.lit("power")))
    assert {r["id"]: r["is_valid"] for r in tagged.collect()} == dict(
        enumerate([False, True, True, True, False, False])
    )
    assert {r["error"] for r in tagged.filter("not is_valid").collect()} == {INVALID_MESSAGE}
    assert {r["error"] for r in tagged.filter("is_valid").collect()} == {None}


def test_negative_zero_is_not_lost_in_the_scan(spark, tmp_path):
    """The filter reaches the Parquet reader, which orders -0.0 below 0.0."""
    path = str(tmp_path / "metrics")
    numbers(spark, [-0.0, -5.0] * 100).coalesce(1).write.parquet(path)
    valid = valid_metrics(validate(spark.read.parquet(path)))
    assert valid.count() == 100
    assert "GreaterThanOrEqual(value,-0.0)" in valid._jdf.queryExecution().executedPlan().toString()


def test_null_value_is_invalid(spark):
    tagged = validate(spark.sql("select cast(null as double) value"))
    assert tagged.first()["is_valid"] is False


def test_custom_rule(spark):
    tagged = validate(numbers(spark, [1, 5]), F.col("value") < 3, "too large")
    assert [(r["is_valid"], r["error"]) for r in tagged.sort("id").collect()] == [(True, None), (False, "too large")]


def test_flatten_and_route(spark, sf_dir):
    readings = sensor_from_events(spark, sf_dir)
    metrics = to_metrics(readings)
    n = readings.count()
    assert metrics.columns == ["deviceId", "timestamp", "name", "value"]
    assert metrics.count() == 3 * n
    tagged = validate(metrics)
    valid, invalid = valid_metrics(tagged), invalid_metrics(tagged)
    assert valid.columns == metrics.columns and invalid.columns == ["metric", "error"]
    assert valid.count() + invalid.count() == 3 * n and invalid.count() > 0
    assert sum(r["metrics"] for r in validation_summary(tagged).collect()) == 3 * n
    assert keep_metric(metrics, "rotorSpeed").exceptAll(to_metrics(readings, ["rotorSpeed"])).count() == 0
    assert "Exchange" not in plan_nodes(valid) and "Exchange" not in plan_nodes(invalid)
    assert "Expand" not in plan_nodes(to_metrics(readings, ["rotorSpeed"]))


def test_route_in_one_pass(spark, sf_dir, tmp_path):
    tagged = validate(to_metrics(sensor_from_events(spark, sf_dir)))
    for routed, want in zip(route_sink(tagged, str(tmp_path / "topics")), (valid_metrics(tagged), invalid_metrics(tagged))):
        assert routed.columns == want.columns and routed.count() == want.count()
        assert routed.exceptAll(want).count() == 0
        plan = routed._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(is_valid" in plan


def test_flatten_order_within_reading(spark):
    one = spark.sql("select 'd' deviceId, timestamp_millis(0) timestamp, named_struct('power', 1d, 'rotorSpeed', 2d, 'windSpeed', 3d) measurements")
    assert [(r["name"], r["value"]) for r in to_metrics(one).collect()] == [("power", 1.0), ("rotorSpeed", 2.0), ("windSpeed", 3.0)]
    with pytest.raises(ValueError):
        to_metrics(one, ["torque"])


def test_position_is_dense(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = with_position(df, ["a", "b"], start=5).sort("pos").collect()
    assert [r["pos"] for r in got] == list(range(5, 1005))
    assert [(r["a"], r["b"]) for r in got] == sorted(rows)


def test_position_with_one_key_for_all_rows(spark):
    """Rows that share the whole order key are still divided over tasks, in stored order."""
    df = spark.range(0, 10_000, 1, 4).select(F.lit(1).alias("a"), "id")
    placed = with_position(df, ["a"])
    assert [r["id"] for r in placed.sort("pos").collect()] == list(range(10_000))
    files = placed.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) < 5_000


def test_position_of_nothing(spark):
    assert with_position(spark.createDataFrame([], "a int"), ["a"]).collect() == []


def test_position_is_the_same_in_every_run(spark):
    df = spark.range(5_000).select(F.rand().alias("a"), "id")
    placed = with_position(df, ["a"])
    assert placed.collect() == placed.collect()
    assert placed.agg(F.count_distinct("pos"), F.max("pos")).first() == (5_000, 4_999)


@pytest.mark.parametrize("hot_rows", [positions.HOT_ROWS, 100])
def test_rank_within(spark, hot_rows):
    """One key holds a third of the rows, and one key is NULL."""
    rng = random.Random(1)
    rows = [(0 if i % 3 == 0 else None if i % 3 == 1 else rng.randrange(1, 50), rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o double, id int")
    got = {r["id"]: r["pos"] for r in rank_within(df, ["k"], ["o", "id"], hot_rows=hot_rows).collect()}
    want = {}
    by_key = lambda r: (r[0] is not None, r[0] or 0)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (by_key(r), r[1], r[2])), by_key):
        want.update({r[2]: i for i, r in enumerate(group)})
    assert got == want


@pytest.mark.parametrize("n", [1, 5, 40])
@pytest.mark.parametrize("rows", [0, 1, 4, 5, 6, 11, 85])
def test_count_windows(spark, n, rows):
    rng = random.Random(rows)
    values = [rng.uniform(0, 100) for _ in range(rows)]
    df = numbers(spark, values)
    got = count_windows(df, n, order_by=["id"]).sort("window").collect()
    groups = [values[i : i + n] for i in range(0, rows, n)]
    assert [(r["window"], r["rows"], r["average"], r["last_pos"]) for r in got] == [
        (i, len(g), fold(g), i * n + len(g) - 1) for i, g in enumerate(groups)
    ]
    full = count_windows(df, n, order_by=["id"], emit_partial=False)
    assert full.count() == rows // n


def test_average_is_the_running_one(spark):
    got = count_windows(numbers(spark, [0.1, 0.2, 0.7, 1.3, 9.1]), order_by=["id"]).first()
    assert got["average"] == 2.2800000000000002
    got = count_windows(numbers(spark, [1, math.inf, 1]), order_by=["id"]).first()
    assert math.isnan(got["average"])
    got = count_windows(numbers(spark, [-0.0]), order_by=["id"]).first()
    assert got["average"] == 0.0


@pytest.mark.parametrize("hot_rows", [positions.HOT_ROWS, 50])
def test_count_windows_per_key(spark, hot_rows):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"d{rng.randrange(30)}", i, rng.uniform(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "device string, id int, value double")
    got = {
        (r["device"], r["window"]): (r["rows"], r["average"], r["last_pos"])
        for r in count_windows(df, 5, order_by=["id"], key="device", hot_rows=hot_rows).collect()
    }
    want = {}
    for key in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == key]
        for w, i in enumerate(range(0, len(values), 5)):
            group = values[i : i + 5]
            want[key, w] = (len(group), fold(group), i + len(group) - 1)
    assert got == want


def test_demand_batches(spark):
    got = demand_batches(numbers(spark, range(12)), 5, order_by=["id"]).sort("id").collect()
    assert [r["batch"] for r in got] == [i // 5 for i in range(12)]
    assert [r["id"] for r in got if r["asks_next"]] == [4, 9]


def test_targets(spark):
    ports = [7000, 7001, 7002]
    placed = assign_targets(numbers(spark, range(300)), ports, order_by=["id"])
    listed = spark.createDataFrame([(p,) for p in [*ports, 7003]], "target int")
    hits = {r["target"]: r["hits"] for r in hits_per_target(placed, listed).collect()}
    assert hits == {7000: 100, 7001: 100, 7002: 100, 7003: 0}
    numbered = assign_targets(numbers(spark, range(10)), 4, order_by=["id"])
    hits = {r["target"]: r["hits"] for r in hits_per_target(numbered, [0, 1, 2, 3, 4]).collect()}
    assert hits == {0: 3, 1: 3, 2: 2, 3: 2, 4: 0}


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_ties_within_a_key_go_by_the_stored_order(spark, tmp_path, hot_rows):
    path = str(tmp_path / "rows")
    spark.range(600).select("id", (F.col("id") % 2).alias("key"), F.lit(0).alias("t")).coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path).sort(F.desc("id")).repartition(1).sortWithinPartitions(F.xxhash64("id"))
    at = {r.id: i for i, r in enumerate(stored.collect())}
    ranked = rank_within(stored, ["key"], ["t"], hot_rows=hot_rows)
    if hot_rows > 600:
        assert "_stored_at" in ranked._jdf.queryExecution().analyzed().toString()
    for key in (0, 1):
        got = [r.id for r in ranked.filter(F.col("key") == key).sort("pos").collect()]
        assert got == sorted(got, key=at.get)


def test_hits_add_up_to_the_rows(spark):
    rows = spark.createDataFrame([(1,), (1,), (9,), (None,)], "target int")
    want = {1: 2, 2: 0, 9: 1, None: 1}
    for targets in ([1, 2], spark.createDataFrame([(1,), (2,)], "target int")):
        assert {r["target"]: r["hits"] for r in hits_per_target(rows, targets).collect()} == want


def arrivals(spark, times):
    rows = list(enumerate(times))
    return spark.createDataFrame(rows, "id int, ms bigint").withColumn("timestamp", F.timestamp_millis("ms"))


CROWDS = {
    "all in one window": [5] * 120,
    "exactly the quota": [7] * 50,
    "one more": [7] * 51,
    "bursts and idle": [0] * 130 + [10_000] * 60 + [10_500] * 3 + [90_000],
    "before 1970": [-5_000] * 70 + [-1] * 70 + [0] * 10,
    "sparse": list(range(0, 300_000, 1_700)),
    "random": sorted(random.Random(9).randrange(0, 40_000) for _ in range(2_500)),
    "none": [],
}


def wait_in_line(windows, quota):
    """Slot of each row, one row after the other."""
    slots = []
    for i, window in enumerate(windows):
        free = slots[i - quota] + 1 if i >= quota else window
        slots.append(max(window, free))
    return slots


@pytest.mark.parametrize("crowd", CROWDS)
@pytest.mark.parametrize("quota", [7, 50])
def test_quota(spark, crowd, quota):
    times = CROWDS[crowd]
    windows = [t // 1000 for t in times]
    df = arrivals(spark, times)
    seen, admitted = {}, []
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
        admitted.append(seen[window] <= quota)
    got = admit_quota(df, 1000, quota, order_by=["timestamp", "id"], hot_rows=60).sort("id").collect()
    assert [(r["window"], r["admitted"]) for r in got] == list(zip(windows, admitted))

    # with the table of windows broadcast, and too large for that
    for sizes in ({}, {"block_rows": 40}):
        timed = schedule_quota(df, 1000, quota, order_by=["timestamp", "id"], **sizes)
        got = timed.sort("id").collect()
        assert [r["window"] for r in got] == windows
        assert [r["slot"] for r in got] == wait_in_line(windows, quota)


def test_no_window_over_all_rows(spark, sf_dir):
    metrics = to_metrics(sensor_from_events(spark, sf_dir), ["rotorSpeed"], keep=EVENT_ORDER)
    nodes = plan_nodes(count_windows(metrics, order_by=EVENT_ORDER))
    assert "Window" not in nodes and "Sort" not in nodes


def test_schedule_lets_nobody_overtake(spark):
    """Arrivals at 5, 1, 5, 9 s in that order, then a row without a time; also with the first rows unknown."""
    rows = [(0, 5), (1, 1), (2, 5), (3, 9), (4, None)]
    df = spark.createDataFrame(rows, "n int, s int").selectExpr("n", "timestamp_seconds(s) AS timestamp")
    for sizes in ({}, {"block_rows": 2}):
        got = schedule_quota(df, 1000, 1, order_by=["n"], **sizes).orderBy("n").collect()
        assert [r.slot for r in got] == [5, 6, 7, 9, 10]
    late = df.selectExpr("4 - n AS n", "timestamp")
    assert [r.slot for r in schedule_quota(late, 1000, 1, order_by=["n"]).orderBy("n").collect()] == [None, 9, 10, 11, 12]
