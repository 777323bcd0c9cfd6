"""Count windows on streams.

Rows arrive batch by batch, and within a batch in the order of ``order_by``.
"""

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators.count_windows import average_of, group_rows
from windrow.operators.positions import HOT_ROWS, place, rank_within
from windrow.storage import has_child, make_dir, materialize
from windrow.streaming.carry import CHANGES, last_carry, read_carry, write_carry
from windrow.streaming.change_log import read_changes, write_changes
from windrow.streaming.keyed import fold_windows


def _state_schema(key_fields: list[T.StructField]) -> T.StructType:
    """Per key: the next position, and the values of the open window (fewer than ``n``)."""
    return T.StructType(
        [
            *key_fields,
            T.StructField("next_pos", T.LongType()),
            T.StructField("held", T.ArrayType(T.DoubleType())),
        ]
    )


def _place_batch(slim, state, keys, order_by, scratch, hot_rows) -> DataFrame:
    """Positions that go on where the state of the key, or of the stream, stopped."""
    if not keys:
        start = state.agg(F.max("next_pos")).first()[0] or 0
        return place(slim, order_by, start=start, path=f"{scratch}/ordered")[0]
    known = state.select(*keys, F.col("next_pos").alias("start"))
    return rank_within(slim, keys, order_by, hot_rows=hot_rows, path=scratch, start=known)


def window_batch(
    batch: DataFrame,
    batch_id: int,
    *,
    out: str,
    carry: str,
    n: int,
    order_by: list[str],
    key: str | None = None,
    value: str = "value",
    hot_rows: int = HOT_ROWS,
) -> None:
    """One micro-batch of a count window over all rows of a stream or per key; for ``foreachBatch``.

    Windows that are full are written to ``out/batch=<id>``; the values of the open windows and the
    next positions are kept in ``carry``, per key as a log of which a batch reads and writes its own keys. A
    batch that is run again reads the same state and replaces its own output.
    """
    keys = [key] if key else []
    scratch, log = f"{carry}/scratch", f"{carry}/{CHANGES}"
    slim = batch.select(*dict.fromkeys([*keys, *order_by, value]))
    schema = _state_schema([slim.schema[k] for k in keys])
    if keys:
        state = read_changes(batch.sparkSession, log, batch_id - 1, schema, keys, slim)
    else:
        state = read_carry(batch.sparkSession, carry, batch_id - 1, schema)

    placed = _place_batch(slim, state, keys, order_by, scratch, hot_rows)
    held = state.select(
        *keys, (F.col("next_pos") - F.size("held")).alias("_first"), F.posexplode("held")
    )
    held = held.select(*keys, (F.col("_first") + F.col("pos")).alias("pos"), F.col("col").alias("value"))
    rows = held.unionByName(placed.select(*keys, "pos", F.col(value).alias("value")))
    windows = materialize(group_rows(rows, n, keys), "windows", f"{scratch}/windows")

    full = F.col("rows") == n
    average_of(windows.filter(full)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    nothing = F.array().cast("array<double>")
    now = windows.select(
        *keys,
        (F.col("last_pos") + 1).alias("next_pos"),
        F.when(full, nothing).otherwise(F.col("values")).alias("held"),
    )
    latest = state.unionByName(now).groupBy(*keys).agg(
        F.coalesce(F.max("next_pos"), F.lit(0)).cast("bigint").alias("next_pos"),
        F.coalesce(F.max_by("held", "next_pos"), nothing).alias("held"),
    )
    if keys:
        write_changes(latest, log, batch_id, keys)
    else:
        write_carry(latest, carry, batch_id)


def stream_count_windows(
    df: DataFrame,
    n: int = 5,
    *,
    order_by: list[str],
    out: str,
    checkpoint: str,
    key: str | None = None,
    value: str = "value",
    hot_rows: int = HOT_ROWS,
    trigger: dict | None = None,
):
    """Average of every ``n`` consecutive rows of a stream, over all rows or per ``key``.

    The state is kept beside the checkpoint: one row in all, or one per key, of which a batch writes those
    of its own keys. Keys with very many rows in a batch are divided over tasks.
    """
    work = partial(
        window_batch,
        out=out,
        carry=f"{checkpoint}/carry",
        n=n,
        order_by=order_by,
        key=key,
        value=value,
        hot_rows=hot_rows,
    )
    make_dir(df.sparkSession, out)
    writer = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_windows(
    spark: SparkSession, out: str, checkpoint: str, n: int = 5, emit_partial: bool = True
) -> DataFrame:
    """Windows written so far. ``emit_partial`` adds the open ones of a stream that has ended."""
    windows = spark.read.parquet(out).drop("batch")
    if not emit_partial:
        return windows
    held = F.size("held").cast("bigint")
    carry = f"{checkpoint}/carry"
    if has_child(spark, carry, CHANGES):
        key_fields = [f for f in windows.schema.fields if f.name not in ("window", "rows", "average", "last_pos")]
        keys = [f.name for f in key_fields]
        state = read_changes(spark, f"{carry}/{CHANGES}", None, _state_schema(key_fields), keys)
    else:
        keys, state = [], last_carry(spark, carry)
    open_windows = state.filter(held > 0)
    return windows.unionByName(
        average_of(
            open_windows.select(
                *keys,
                F.call_function("div", F.col("next_pos") - held, F.lit(n)).alias("window"),
                held.alias("rows"),
                F.col("held").alias("values"),
                (F.col("next_pos") - 1).alias("last_pos"),
            )
        )
    )


def stream_windows_per_key(
    df: DataFrame, n: int = 5, *, key: str, order_by: list[str], value: str = "value"
) -> DataFrame:
    """The same per key with Spark's state store, which writes only the keys that change.

    For very many keys and batches that the source limits (``batch_limit`` of ``topic_source``): the
    rows of a key in one micro-batch are sorted in one task. Where one key may have very many rows
    in a batch, use ``stream_count_windows`` with ``key``. The result is a stream of full windows; those that are
    still open when the stream has ended are in ``open_windows``.
    """
    missing = "_missing"
    order = {f"_order_{i}": _order_column(df, name) for i, name in enumerate(order_by)}
    slim = df.select(*dict.fromkeys([key, value]), F.col(value).isNull().alias(missing), *[c.alias(name) for name, c in order.items()])
    key_field = T.StructField(key, df.schema[key].dataType)
    output = T.StructType(
        [
            key_field,
            T.StructField("window", T.LongType()),
            T.StructField("average", T.DoubleType()),
            T.StructField("is_nan", T.BooleanType()),
        ]
    )
    windows = slim.groupBy(key).applyInPandasWithState(
        fold_windows(n, key, list(order), value, missing),
        output,
        "window bigint, held array<double>",
        "append",
        "NoTimeout",
    )
    average = F.when(F.col("is_nan"), F.lit(float("nan"))).otherwise(F.col("average"))
    last = F.col("window") * n + (n - 1)
    # columns that follow from the number of the window need not come out of Python
    return windows.select(key, "window", F.lit(n).cast("bigint").alias("rows"), average.alias("average"), last.alias("last_pos"))


def _order_column(df: DataFrame, name: str) -> Column:
    """A column to sort by in pandas: times as microseconds, whose conversion is costly for each key."""
    return F.unix_micros(name) if isinstance(df.schema[name].dataType, T.TimestampType) else F.col(name)


def open_windows(
    spark: SparkSession, checkpoint: str, n: int = 5, *, key: str, batch_id: int | None = None
) -> DataFrame:
    """The windows per key that ``stream_windows_per_key`` holds back: fewer than ``n`` rows each.

    Read from the state store of the stopped or running query with this checkpoint, as the last batch
    that was committed left it (or ``batch_id``, for as long as the store keeps it). Together with the full
    windows of the same batches they are ``count_windows`` with partial groups. No job of the query
    is run again and its state is not changed, so that it can go on later.
    """
    states = spark.read.format("statestore")
    if batch_id is not None:
        states = states.option("batchId", batch_id)
    held = F.col("value.groupState.held")
    kept = states.load(checkpoint).filter(F.size(held) > 0)
    rows = F.size(held).cast("bigint")
    window = F.col("value.groupState.window")
    return average_of(
        kept.select(
            F.col(f"key.{key}").alias(key),
            window.alias("window"),
            rows.alias("rows"),
            held.alias("values"),
            (window * n + rows - 1).alias("last_pos"),
        )
    )
