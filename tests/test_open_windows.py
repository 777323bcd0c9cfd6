"""Open windows per key out of the state store: with the full ones they are the windows of the table."""

import math

import pytest
from pyspark.sql import functions as F

from windrow.operators.count_windows import count_windows
from windrow.sources.topics import topic_source
from windrow.streaming.windows import open_windows, read_windows, stream_count_windows, stream_windows_per_key

ROWS = "k string, t long, value double"
NAN, INF = float("nan"), float("inf")


def rows():
    """Groups that do not end evenly, a key with a third of all rows, ties in the order, NULL, NaN and infinity."""
    out = [("hot", t, float(t % 13)) for t in range(101)]
    out += [(f"k{t % 17}", t, t / 7) for t in range(150)]
    out += [("null key" if t % 2 else None, t, 1.0 + t) for t in range(9)]
    out += [("ties", t // 4, 2.5) for t in range(11)]  # equal rows: their order does not show
    out += [("null", t, None if t % 4 == 0 else float(t)) for t in range(8)]
    out += [("nan", t, NAN if t == 6 else float(t)) for t in range(8)]
    out += [("both", t, None if t == 1 else NAN if t == 3 else 1.0) for t in range(7)]
    out += [("inf", t, INF if t in (2, 6) else -1.0) for t in range(9)]
    out += [("order null", None if t < 2 else t, 4.0) for t in range(6)]
    return out + [("one", 0, 3.0), ("even", 0, 1.0), *[("even", t, 1.0) for t in range(1, 5)]]


def shown(df):
    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)

    return sorted(tuple(map(cell, r)) for r in df.select("k", "window", "rows", "average", "last_pos").collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), ROWS)


def started(df, out, checkpoint):
    keyed = stream_windows_per_key(df, 5, key="k", order_by=["t"])
    query = keyed.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start(out).awaitTermination()


def test_batch_stream_and_state_store(spark, table, tmp_path):
    """Three ways to the same windows; the stream stops twice, also with nothing new."""
    source, out, checkpoint, out2, checkpoint2 = (str(tmp_path / p) for p in ("in", "a", "b", "c", "d"))
    thirds = [table.filter("coalesce(t, 0) < 3"), table.filter("t >= 3 AND t < 6"), table.filter("t >= 6")]
    for part in thirds:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = topic_source(spark, source, table.schema)
        started(stream, out, checkpoint)
        stream_count_windows(stream, 5, order_by=["t"], out=out2, checkpoint=checkpoint2, key="k").awaitTermination()
    started(stream, out, checkpoint)
    want = count_windows(table, 5, order_by=["t"], key="k", emit_partial=True)
    found = spark.read.parquet(out).unionByName(open_windows(spark, checkpoint, 5, key="k"))
    assert shown(found) == shown(want)
    assert shown(read_windows(spark, out2, checkpoint2, 5)) == shown(want)


def test_open_windows_only(spark, table, tmp_path):
    """An earlier batch can be asked for, and asking changes nothing."""
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    numbered = table.filter("k = 'hot'")
    for low in (0, 33, 66):
        numbered.filter(F.col("t").between(low, low + 32)).coalesce(1).write.mode("append").parquet(source)
        started(topic_source(spark, source, table.schema, batch_limit=1), out, checkpoint)
    # 33, 66 and 99 rows have come
    assert [r["rows"] for r in open_windows(spark, checkpoint, 5, key="k", batch_id=0).collect()] == [3]
    assert [r["rows"] for r in open_windows(spark, checkpoint, 5, key="k", batch_id=1).collect()] == [1]
    assert [(r["window"], r["rows"], r["last_pos"]) for r in open_windows(spark, checkpoint, 5, key="k").collect()] == [(19, 4, 98)]
    numbered.filter("t > 98").coalesce(1).write.mode("append").parquet(source)
    started(topic_source(spark, source, table.schema), out, checkpoint)
    found = spark.read.parquet(out).unionByName(open_windows(spark, checkpoint, 5, key="k"))
    assert shown(found) == shown(count_windows(numbered, 5, order_by=["t"], key="k"))
