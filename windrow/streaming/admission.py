"""Quota admission on streams."""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators.positions import HOT_ROWS, rank_within
from windrow.operators.quota import QUOTA, WINDOW_MS, window_index
from windrow.storage import make_dir
from windrow.streaming.carry import CHANGES, read_carry, write_carry
from windrow.streaming.change_log import read_changes, write_changes

# Rows seen per window so far.
_SEEN = T.StructType([T.StructField("window", T.LongType()), T.StructField("seen", T.LongType())])


def admit_batch(
    batch: DataFrame,
    batch_id: int,
    *,
    out: str,
    carry: str,
    quota: int,
    order_by: list[str],
    late_windows: int | None,
    hot_rows: int,
) -> None:
    """One micro-batch; a row counts after the rows of its window in earlier batches."""
    spark, log = batch.sparkSession, f"{carry}/{CHANGES}"
    arrived = batch.groupBy("window").agg(F.count("*").alias("seen"))
    if late_windows is None:
        seen = read_changes(spark, log, batch_id - 1, _SEEN, ["window"], arrived)
    else:
        seen = read_carry(spark, carry, batch_id - 1, _SEEN)
        newest = seen.agg(F.max("window")).first()[0]
    before = seen.select("window", F.col("seen").alias("start"))
    ranked = rank_within(
        batch, ["window"], order_by, "_rank", hot_rows, f"{carry}/scratch", start=before
    )
    admitted = F.col("_rank") < quota
    if late_windows is not None and newest is not None:
        admitted = admitted & (F.col("window") > newest - late_windows)
    rows = ranked.withColumn("admitted", admitted).drop("_rank")
    rows.write.mode("overwrite").parquet(f"{out}/from={batch_id}")

    total = seen.unionByName(arrived).groupBy("window").agg(F.sum("seen").alias("seen"))
    if late_windows is None:
        write_changes(total, log, batch_id, ["window"])
    else:
        latest = arrived.agg(F.max("window")).first()[0]
        latest = max((w for w in (latest, newest) if w is not None), default=None)
        if latest is not None:
            total = total.filter(F.col("window") > latest - late_windows)
        write_carry(total, carry, batch_id)


def stream_admit_quota(
    df: DataFrame,
    window_ms: int = WINDOW_MS,
    quota: int = QUOTA,
    *,
    time: str = "timestamp",
    order_by: list[str],
    out: str,
    checkpoint: str,
    late_windows: int | None = None,
    hot_rows: int = HOT_ROWS,
    trigger: dict | None = None,
):
    """Flag the first ``quota`` rows of each window as admitted, over all batches of a stream.

    Rows arrive batch by batch, and within a batch in the order of ``order_by``. The count of each
    window is kept beside the checkpoint, and a batch writes those of its own windows only; with
    ``late_windows`` only the counts of the windows fewer than that many behind the newest are kept, and
    rows that come later still are written, but not admitted. Read the result with ``read_placed``.
    """
    work = partial(
        admit_batch,
        out=out,
        carry=f"{checkpoint}/carry",
        quota=quota,
        order_by=order_by,
        late_windows=late_windows,
        hot_rows=hot_rows,
    )
    make_dir(df.sparkSession, out)
    windowed = df.withColumn("window", window_index(time, window_ms))
    writer = windowed.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
