"""Dense positions in a given order, over all rows or per key, without a single-task sort.

There is no arrival order in a DataFrame, so the order is always a list of columns. Rows equal in
all of them keep the order in which they are stored.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.storage import materialize

# monotonically_increasing_id: partition number above this bit, row number in the partition below.
_ROW_BITS = 33

# A key with more rows than this is not left to one task.
HOT_ROWS = 5_000_000
# At most this many keys are treated as hot, whatever the size of the table.
MAX_HOT_KEYS = 100_000


def place(
    df: DataFrame,
    order_by: list[str],
    name: str = "pos",
    start: int = 0,
    path: str | None = None,
) -> tuple[DataFrame, int]:
    """The rows with their position in the order of ``order_by``, and the position after the last.

    One range shuffle sorts the rows over all tasks; the sorted rows, each with its row number in
    its partition, are written once. The rows before each partition then follow from the row counts
    per partition: one number per partition, which is all that reaches the driver and is broadcast.
    ``path`` names the place of the written rows, otherwise they get a new one. The input is read
    twice, first to find the ranges: materialise it if it is costly to make.

    The stored order is the last sort column, so that a key shared by very many rows is still
    divided over tasks. Input that is itself shuffled should have a unique ``order_by`` or be
    materialised, as its stored order may change when a lost task is run again (the README names
    the settings that make Spark notice).
    """
    stored = df.withColumn("_stored", F.monotonically_increasing_id())
    ordered = stored.sort(*order_by, "_stored").drop("_stored")
    numbered = ordered.withColumn("_row", F.monotonically_increasing_id())
    marked = materialize(numbered, "ordered", path)

    part = F.shiftright("_row", _ROW_BITS)
    counts = marked.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()
    offsets, end = [], start
    for row in sorted(counts):
        offsets.append((row["part"], end))
        end += row["rows"]
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    row_in_part = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = (
        marked.join(F.broadcast(table), part == F.col("_part"))
        .withColumn(name, F.col("_before") + row_in_part)
        .drop("_row", "_part", "_before")
    )
    return placed, end


def with_position(df: DataFrame, order_by: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by``; see ``place``."""
    return place(df, order_by, name, start)[0]


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition that also matches NULL keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _look_up(df: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Add the other columns of ``table`` (one row per key) to the rows of ``df``."""
    others = [c for c in table.columns if c not in keys]
    table = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *others)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = df.join(F.broadcast(table) if small else table, same, "left")
    return joined.drop(*[f"_{k}" for k in keys])


def rank_within(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
    path: str | None = None,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row among the rows of its key.

    A count per key (combined before the shuffle) finds the keys too large for one task. Their rows
    are sorted over all tasks by ``place``, and the position of the first row of the key is taken
    off; all other keys take a plain window. ``path`` names a folder for what is written on the
    way, otherwise it gets a new one. ``start`` is a table of keys and a column ``start``: the
    position of the first row of the key where that is not 0.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    largest, total = counts.agg(F.max("_rows"), F.sum("_rows")).first()
    # numbered once, so that ties go by the stored order on both ways
    df = df.withColumn("_stored_at", F.monotonically_increasing_id())
    window = Window.partitionBy(*keys).orderBy(*order_by, "_stored_at")

    def windowed(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn(name, (F.row_number().over(window) - 1).cast("bigint")).drop("_stored_at")
        if start is None:
            return ranked
        begun = _look_up(ranked, start, keys, small=False)
        return begun.withColumn(name, F.col(name) + F.coalesce("start", F.lit(0))).drop("start")

    if (largest or 0) <= hot_rows:
        return windowed(df)

    limit = max(hot_rows, total // MAX_HOT_KEYS)
    hot = counts.filter(F.col("_rows") > limit).drop("_rows")
    hot = materialize(hot, "hot-keys", path and f"{path}/hot-keys")
    on_hot = same_key(df, hot, keys)
    calm = windowed(df.join(F.broadcast(hot), on_hot, "left_anti"))

    placed, _ = place(
        df.join(F.broadcast(hot), on_hot, "left_semi"),
        [*keys, *order_by, "_stored_at"],
        "_at",
        path=path and f"{path}/hot-ordered",
    )
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    if start is not None:
        begun = start.join(F.broadcast(hot), same_key(start, hot, keys), "left_semi")
        first = _look_up(first, begun, keys, small=True)
        first = first.withColumn("_first", F.col("_first") - F.coalesce("start", F.lit(0))).drop("start")
    ranked = _look_up(placed, first, keys, small=True)
    ranked = ranked.withColumn(name, F.col("_at") - F.col("_first"))
    return calm.unionByName(ranked.select(*calm.columns))
