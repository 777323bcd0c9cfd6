"""Operators on the position of a row, on streams: positions go on from batch to batch.

Rows arrive batch by batch, and within a batch in the order of ``order_by``.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from windrow.operators.count_windows import number_batches
from windrow.operators.positions import place
from windrow.operators.quota import QUOTA, WINDOW_MS, schedule_placed, window_index
from windrow.operators.targets import deal_targets
from windrow.storage import make_dir
from windrow.streaming.carry import read_carry, write_carry

_CARRY = T.StructType(
    [T.StructField("next_pos", T.LongType()), T.StructField("lowest", T.LongType())]
)

# From placed rows and the value kept by the batch before: the rows to write and the value to keep.
Step = Callable[[DataFrame, int | None], tuple[DataFrame, int | None]]


def _stream_placed(
    df: DataFrame, step: Step, order_by: list[str], out: str, checkpoint: str, trigger: dict | None
):
    carry = f"{checkpoint}/carry"

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start, kept = read_carry(spark, carry, batch_id - 1, _CARRY).first() or (0, None)
        placed, end = place(batch, order_by, start=start, path=f"{carry}/ordered")
        rows, kept = step(placed, kept)
        rows.write.mode("overwrite").parquet(f"{out}/from={batch_id}")
        write_carry(spark.createDataFrame([(end, kept)], _CARRY), carry, batch_id)

    make_dir(df.sparkSession, out)
    writer = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_placed(spark: SparkSession, out: str) -> DataFrame:
    """The rows written so far."""
    return spark.read.parquet(out).drop("from")


def stream_demand_batches(
    df: DataFrame, n: int = 5, *, order_by: list[str], out: str, checkpoint: str, trigger=None
):
    """Number the rows of a stream in batches of ``n``."""
    return _stream_placed(
        df, lambda placed, _: (number_batches(placed, n), None), order_by, out, checkpoint, trigger
    )


def stream_assign_targets(
    df: DataFrame, targets: list, *, order_by: list[str], out: str, checkpoint: str, trigger=None
):
    """Give each row of a stream its target, in turn."""
    return _stream_placed(
        df, lambda placed, _: (deal_targets(placed, targets), None), order_by, out, checkpoint, trigger
    )


def stream_schedule_quota(
    df: DataFrame,
    window_ms: int = WINDOW_MS,
    quota: int = QUOTA,
    *,
    time: str = "timestamp",
    order_by: list[str],
    out: str,
    checkpoint: str,
    trigger=None,
):
    """The window in which each row of a stream gets in. A late row does not overtake those before it."""
    windowed = df.withColumn("window", window_index(time, window_ms))
    return _stream_placed(
        windowed,
        lambda placed, lowest: schedule_placed(placed, quota, lowest=lowest),
        order_by,
        out,
        checkpoint,
        trigger,
    )
