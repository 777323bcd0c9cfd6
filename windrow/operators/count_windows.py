"""Windows of a fixed number of rows, and batch numbers of the same kind."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.integers import floor_div
from windrow.functions.means import incremental_mean
from windrow.operators.positions import HOT_ROWS, rank_within, with_position

# Windows of up to this many rows are gathered in fixed columns, larger ones in a list.
_MAX_SLOTS = 32


def group_rows(
    placed: DataFrame, n: int, keys: list[str], value: str = "value", pos: str = "pos"
) -> DataFrame:
    """Windows of rows that have their position: key, window, rows, values in order, last_pos.

    Each value has a fixed place in its window, so a window is gathered with one max() per place.
    Unlike a list, these are plain numbers that the hash aggregate combines before the shuffle.
    """
    grouped = placed.withColumn("window", floor_div(F.col(pos), n)).groupBy(*keys, "window")
    rows = F.count("*").alias("rows")
    last = F.max(pos).alias("last_pos")
    if n <= _MAX_SLOTS:
        place = F.col(pos) % n
        slots = [F.max(F.when(place == i, F.col(value))).alias(f"_{i}") for i in range(n)]
        windows = grouped.agg(rows, last, *slots)
        values = F.slice(F.array(*[f"_{i}" for i in range(n)]), F.lit(1), F.col("rows").cast("int"))
    else:
        listed = F.sort_array(F.collect_list(F.struct(pos, value))).alias("_list")
        windows = grouped.agg(rows, last, listed)
        values = F.col("_list")[value]
    return windows.select(*keys, "window", "rows", values.alias("values"), "last_pos")


def average_of(windows: DataFrame) -> DataFrame:
    """The incremental mean in place of the values."""
    return windows.withColumn("values", incremental_mean(F.col("values"))).withColumnRenamed(
        "values", "average"
    )


def count_windows(
    df: DataFrame,
    n: int = 5,
    *,
    order_by: list[str],
    key: str | list[str] | None = None,
    value: str = "value",
    emit_partial: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Average of every ``n`` consecutive rows, over all rows or per ``key``.

    The average is the incremental mean in row order. ``last_pos`` is the position of the last row
    of the window, the point up to which the input is done. The shorter last window of the table
    (or key) is left out unless ``emit_partial``.
    """
    keys = [key] if isinstance(key, str) else list(key or [])
    slim = df.select(*dict.fromkeys([*keys, *order_by, value]))
    if keys:
        placed = rank_within(slim, keys, order_by, hot_rows=hot_rows)
    else:
        placed = with_position(slim, order_by)
    windows = average_of(group_rows(placed, n, keys, value))
    return windows if emit_partial else windows.filter(F.col("rows") == n)


def number_batches(placed: DataFrame, n: int = 5) -> DataFrame:
    """Batch number of rows that have their position; ``asks_next`` marks the row that fills one."""
    return placed.withColumn("batch", floor_div(F.col("pos"), n)).withColumn(
        "asks_next", (F.col("pos") + 1) % n == 0
    )


def demand_batches(df: DataFrame, n: int = 5, *, order_by: list[str]) -> DataFrame:
    """Number the rows in batches of ``n``."""
    return number_batches(with_position(df, order_by), n)
