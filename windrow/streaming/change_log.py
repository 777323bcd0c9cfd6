"""State by key of a stream, of which each micro-batch writes only what it changed.

A log is a folder of runs ``run-<first>-<last>``, each with the rows that batches ``first`` to ``last`` left, at most one for
each key. A batch adds a run of its own. When it completes ``fan`` runs of one length, it also writes them as one run, in which the
later row of a key wins, and so on upwards. So after ``b`` batches a reader opens fewer than ``fan * log(b)`` runs, and a row is
written again once per level, not once per batch.

A run counts when its mark is there, which is written last. Runs that went into a longer one stay until the next batch has
begun: the batch that made it may be run again, and then finds what it found before.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators.positions import same_key
from windrow.storage import child_names, has_child, make_dir, remove_dir, write_bytes

#: Runs of one length that become one.
FAN = 8

_RUN = "run-"
_MARK = "_whole"
# The batch that wrote a row.
_VERSION = "_version"


def _run(first: int, last: int) -> str:
    return f"{_RUN}{first}-{last}"


def _cover(spark: SparkSession, log: str, last: int | None) -> list[str]:
    """Whole runs that together hold batches 0 to ``last``, or to the last one that is there; the longest first."""
    make_dir(spark, log)
    ends: dict[int, list[int]] = {}
    for name in child_names(spark, log):
        if name.startswith(_RUN):
            a, b = map(int, name.removeprefix(_RUN).split("-"))
            if last is None or b <= last:
                ends.setdefault(a, []).append(b)
    cover, first = [], 0
    while last is None or first <= last:
        whole = (b for b in sorted(ends.get(first, []), reverse=True) if has_child(spark, f"{log}/{_run(first, b)}", _MARK))
        end = next(whole, None)
        if end is None:
            break
        cover.append(_run(first, end))
        first = end + 1
    if last is not None and first <= last:
        raise RuntimeError(f"{log} does not hold the state after batch {last}: batch {first} is missing")
    return cover


def _rows(spark: SparkSession, log: str, runs: list[str], schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(_VERSION, T.LongType())])
    if not runs:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(*[f"{log}/{run}" for run in runs])


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key, with its version."""
    others = [c for c in rows.columns if c not in (*keys, _VERSION)]
    latest = rows.groupBy(*keys).agg(F.max(_VERSION).alias(_VERSION), F.max_by(F.struct(*others), _VERSION).alias("_row"))
    return latest.select(*keys, *[F.col("_row")[c].alias(c) for c in others], _VERSION).select(*rows.columns)


def read_changes(
    spark: SparkSession,
    log: str,
    batch_id: int | None,
    schema: T.StructType,
    keys: list[str],
    touched: DataFrame | None = None,
) -> DataFrame:
    """The last row of each key up to ``batch_id`` (None: all there is); with ``touched`` only of the keys in that table.

    ``touched`` needs the key columns and may repeat keys. NULL and NaN are keys of their own. Batches are counted from 0, so
    -1 gives the empty state before the first; a state that is not whole any more is an error.
    """
    rows = _rows(spark, log, _cover(spark, log, batch_id), schema)
    if touched is not None:
        wanted = touched.select(*keys).distinct()
        rows = rows.join(wanted, same_key(rows, wanted, keys), "left_semi")
    return _newest(rows, keys).drop(_VERSION)


def write_changes(rows: DataFrame, log: str, batch_id: int, keys: list[str], fan: int = FAN) -> None:
    """Add the rows that a batch changed, one for each key. A batch that is run again replaces its own."""
    spark = rows.sparkSession

    def write(run: str, changed: DataFrame) -> None:
        changed.write.mode("overwrite").parquet(f"{log}/{run}")
        write_bytes(spark, f"{log}/{run}/{_MARK}", b"")

    write(_run(batch_id, batch_id), rows.withColumn(_VERSION, F.lit(batch_id).cast("long")))
    for run, parts in _merges(batch_id, fan):
        write(run, _newest(_rows(spark, log, parts, rows.schema), keys))
    for _, parts in _merges(batch_id - 1, fan):
        for part in parts:
            remove_dir(spark, f"{log}/{part}")


def _merges(batch_id: int, fan: int) -> list[tuple[str, list[str]]]:
    """The runs that a batch completes, shortest first, and the parts of each."""
    if fan < 2:
        raise ValueError("at least two runs become one")
    merges, size = [], fan
    while batch_id >= 0 and (batch_id + 1) % size == 0:
        part, begin = size // fan, batch_id + 1 - size
        merges.append((_run(begin, batch_id), [_run(a, a + part - 1) for a in range(begin, batch_id + 1, part)]))
        size *= fan
    return merges
