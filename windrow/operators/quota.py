"""At most ``quota`` rows per time window: who gets in at once, and when the others do.

Every window grants the full quota if rows that got in are done by the next window. If only ``drain`` of them are,
the others stand in a queue, and the window grants what its depth leaves of the quota.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.functions.integers import floor_div
from windrow.operators.positions import HOT_ROWS, rank_within, with_position
from windrow.operators.queue_depth import BLOCK_WINDOWS, queue_depths
from windrow.storage import materialize

# Rows granted per window, and the length of a window.
QUOTA = 50
WINDOW_MS = 1000

# Rows are looked at in blocks of this many positions.
BLOCK_ROWS = 1_000_000

# A table of so many windows (two numbers each) is broadcast to the rows.
_FEW_WINDOWS = 200_000


def window_index(time: str, window_ms: int) -> Column:
    """Number of the window a time falls into, counted from the epoch."""
    return floor_div(F.unix_millis(F.col(time)), window_ms)


def admit_quota(
    df: DataFrame,
    window_ms: int = WINDOW_MS,
    quota: int = QUOTA,
    *,
    time: str = "timestamp",
    order_by: list[str],
    drain: int | None = None,
    hot_rows: int = HOT_ROWS,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Flag the first rows of each window as admitted, as many as it grants; the rest is kept, not admitted.

    A window grants ``quota`` rows. With ``drain`` it grants ``quota - depth``, where ``depth`` (a column of its own then)
    counts the rows admitted before that are not done yet: ``drain`` are done by the end of each window, empty ones too. Rows
    without a time are a group of their own, with nothing before them.
    """
    numbered = df.withColumn("window", window_index(time, window_ms))
    if drain is None:
        ranked = rank_within(numbered, ["window"], order_by, "_rank", hot_rows)
        return ranked.withColumn("admitted", F.col("_rank") < quota).drop("_rank")
    numbered = materialize(numbered, "windowed")
    depths = queue_depths(numbered.groupBy("window").agg(F.count("*").alias("arrivals")), quota, drain, block_windows)
    depths = materialize(depths.withColumnRenamed("window", "_window"), "depths")
    side = F.broadcast(depths) if depths.count() <= _FEW_WINDOWS else depths
    ranked = rank_within(numbered, ["window"], order_by, "_rank", hot_rows)
    known = ranked.join(side, F.col("window") == F.col("_window"), "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    return known.withColumn("admitted", F.col("_rank") < quota - F.col("depth")).drop("_rank", "_window")


def _lowest_by_block(placed: DataFrame, quota: int, block_rows: int) -> DataFrame:
    """Running minimum of the levels, row by row, for any number of rows and windows.

    Blocks of positions hold the same number of rows whatever the arrival times are. The minimum
    runs within each block, and over the blocks (one row each) to carry it on.
    """
    blocked = placed.withColumn("_block", floor_div(F.col("pos"), block_rows)).withColumn(
        "_level", F.col("pos") - quota * F.col("window")
    )
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy("_block")
        .agg(F.min("_level").alias("_low"))
        .select("_block", F.min("_low").over(before).alias("_carry"))
    )
    within = Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lowest = blocked.withColumn("_within", F.min("_level").over(within)).join(carried, "_block")
    # least() skips the NULL before the first block
    return lowest.withColumn("_lowest", F.least("_within", "_carry")).drop(
        "_block", "_level", "_within", "_carry"
    )


def schedule_placed(
    placed: DataFrame,
    quota: int,
    *,
    lowest: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, int | None]:
    """Slots of rows that have their position and window, and the lowest level up to their end.

    A row at position i has slot floor((i - low) / quota), where low is the lowest level of the rows up to
    it, and the level of a row is position - quota * window: it is lowest where nobody was left waiting. No row
    overtakes one before it, whatever their times are. A row without a time arrives with the row before it; if
    there is none with a time, it has no slot. ``lowest`` is the lowest level of earlier rows.
    """
    timed = _lowest_by_block(placed, quota, block_rows)
    low = placed.agg(F.min(F.col("pos") - quota * F.col("window"))).first()[0]
    if lowest is not None:
        timed = timed.withColumn("_lowest", F.least("_lowest", F.lit(lowest)))
        low = lowest if low is None else min(low, lowest)
    slot = floor_div(F.col("pos") - F.col("_lowest"), quota)
    return timed.withColumn("slot", slot).drop("_lowest"), low


def schedule_quota(
    df: DataFrame,
    window_ms: int = WINDOW_MS,
    quota: int = QUOTA,
    *,
    time: str = "timestamp",
    order_by: list[str],
    **sizes,
) -> DataFrame:
    """The window in which each row gets in (``slot``) if rows wait first come, first served.

    Who came first is told by ``order_by``, which need not follow ``time``.
    """
    placed = with_position(df.withColumn("window", window_index(time, window_ms)), order_by)
    return schedule_placed(placed, quota, **sizes)[0]
