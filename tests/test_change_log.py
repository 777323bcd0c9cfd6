"""State of which each batch writes only what it changed."""

import random

import pytest
from pyspark.sql import functions as F

from windrow.operators.count_windows import count_windows
from windrow.sources.topics import topic_source
from windrow.storage import child_names, remove_dir
from windrow.streaming import windows
from windrow.streaming.change_log import read_changes, write_changes
from windrow.streaming.windows import read_windows, stream_count_windows

SCHEMA = "key double, value bigint"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def state(spark, log, batch_id=None, touched=None):
    rows = read_changes(spark, log, batch_id, table(spark, []).schema, ["key"], touched).collect()
    found = {str(r["key"]): r["value"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_the_later_row_wins(spark, tmp_path):
    """Random changes, NULL and NaN among the keys, over merges of two levels; every batch is run twice."""
    log, want, dice = str(tmp_path / "log"), {}, random.Random(7)
    keys = [None, float("nan"), 0.0, 1.0, 2.0, 3.0]
    assert state(spark, log, -1) == {}
    for batch in range(10):
        changed = [(k, dice.randrange(1000)) for k in dice.sample(keys, dice.randrange(4))]
        for _ in range(2):
            assert state(spark, log, batch - 1) == want
            write_changes(table(spark, changed), log, batch, ["key"], fan=3)
        want = want | {str(k): v for k, v in changed}
        assert state(spark, log, batch) == state(spark, log) == want
    some = table(spark, [(None, 0), (1.0, 0), (1.0, 0), (9.0, 0)])
    assert state(spark, log, 9, some) == {k: want[k] for k in ("None", "1.0") if k in want}


def test_a_batch_writes_what_it_changed(spark, tmp_path):
    """New keys in every batch: its own run stays as small, each row is written once per level, readers open few runs."""
    log, batches, fan = str(tmp_path / "log"), 70, 4
    written, seen, most = 0, set(), 0
    for batch in range(batches):
        write_changes(table(spark, [(float(batch), 1), (batch + 0.5, 2)]), log, batch, ["key"], fan=fan)
        runs = set(child_names(spark, log))
        most = max(most, len(runs))
        for run in runs - seen:
            rows = spark.read.parquet(f"{log}/{run}").count()
            written += rows
            first, last = map(int, run.removeprefix("run-").split("-"))
            assert rows == 2 * (last - first + 1)
        seen |= runs
    levels = 4  # of 1, 4, 16 and 64 batches
    assert written <= 2 * batches * levels
    assert most <= 2 * fan * levels
    assert len(state(spark, log)) == 2 * batches


def test_an_unfinished_run_does_not_count(spark, tmp_path):
    log = str(tmp_path / "log")
    for batch in range(4):
        write_changes(table(spark, [(0.0, batch), (float(batch), 9)]), log, batch, ["key"], fan=4)
    whole = state(spark, log)
    (tmp_path / "log" / "run-0-3" / "_whole").unlink()  # as if the batch had died while it merged
    assert state(spark, log) == whole == state(spark, log, 3)
    (tmp_path / "log" / "run-3-3" / "_whole").unlink()
    assert state(spark, log) == state(spark, log, 2) != whole
    with pytest.raises(RuntimeError, match="after batch 3"):
        state(spark, log, 3)
    remove_dir(spark, f"{log}/run-1-1")
    with pytest.raises(RuntimeError, match="batch 1 is missing"):
        state(spark, log, 2)


@pytest.mark.parametrize("died", [4, 7])
def test_windows_per_key_after_a_failure(spark, tmp_path, monkeypatch, died):
    """A batch dies before its state is written, one of them the batch that merges; keys come and go."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    rows = spark.range(180).select(
        F.expr("cast(id * id % 7 + id div 60 as string)").alias("device"), "id", (F.col("id") * 0.5).alias("value")
    )
    for k in range(9):
        rows.filter(F.expr(f"id div 20 = {k}")).coalesce(1).write.mode("append").parquet(source)
    real = windows.write_changes

    def dies(changed, log, batch_id, keys):
        if batch_id == died:
            raise RuntimeError("lost")
        real(changed, log, batch_id, keys)

    def run():
        stream = topic_source(spark, source, rows.schema, batch_limit=1)
        stream_count_windows(stream, order_by=["id"], out=out, checkpoint=checkpoint, key="device").awaitTermination()

    with monkeypatch.context() as patch:
        patch.setattr(windows, "write_changes", dies)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    columns = ["device", "window", "rows", "average", "last_pos"]
    want = count_windows(rows, order_by=["id"], key="device")
    got = read_windows(spark, out, checkpoint)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
