"""Topics with a commit log: readers see whole batches, each once, whatever was tried and failed before.

A topic is a folder with ``data/<attempt>/`` (Parquet files of one attempt to write a batch) and ``log/``, where a batch
has one small entry that names the attempt that counts. Files come first, under a name that no other attempt has; the entry is
then moved to the batch's name, which fails if there is one. So a batch that is run again publishes nothing, files of a
failed attempt are never read, and a published file never changes. Readers, batch or stream, go by the entries only.

``follow_records`` hands over a topic by demand: micro-batches of exactly ``n`` records. The files of new entries are laid
end to end by record count; a micro-batch is a few ranges of rows in files, which Spark's reader cuts out by the row index it
has anyway. Records do not leave the JVM for it. Whole micro-batches that are there may be handed over many at once, so that the
number of Spark jobs does not grow with the number of micro-batches.
"""

import json
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from windrow.storage import child_names, has_child, make_dir, materialize, remove_dir, rename_new, write_bytes
from windrow.streaming.carry import last_carry, read_carry, write_carry

_ENTRY = T.StructType([T.StructField("attempt", T.StringType()), T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])
_COUNTED = T.StructType([*_ENTRY.fields, T.StructField("counts", T.MapType(T.StringType(), T.LongType()))])
# A stretch of rows of one file: its first record's place in the topic, its first row in the file, and how many.
_SPAN = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType())])

Work = Callable[[DataFrame, int], None]


def _entry(batch_id: int, writer: str) -> str:
    return f"{writer}-{batch_id:012d}.json"


def make_topic(spark: SparkSession, topic: str) -> None:
    """An empty topic, which can be followed before its first batch."""
    make_dir(spark, f"{topic}/log")
    make_dir(spark, f"{topic}/data")


def publish(
    rows: DataFrame, topic: str, batch_id: int, writer: str = "batch", counted: Callable[[], dict[str, int]] | None = None
) -> bool:
    """Add a batch; False if it is there already, and then ``rows`` are not even computed.

    ``batch_id`` tells the batches of one ``writer`` apart. Several writers may add to one topic. ``counted`` is called
    when the rows are written, and what it returns goes into the entry: see ``published_counts``.
    """
    spark = rows.sparkSession
    make_topic(spark, topic)
    name = _entry(batch_id, writer)
    if has_child(spark, f"{topic}/log", name):
        return False
    attempt = f"{writer}-{batch_id:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{topic}/data/{attempt}")
    staged = f"{topic}/data/{attempt}/_entry"
    entry = {"attempt": attempt, "writer": writer, "batch": batch_id}
    if counted:
        entry["counts"] = counted()
    write_bytes(spark, staged, json.dumps(entry).encode() + b"\n")
    return rename_new(spark, staged, f"{topic}/log/{name}")


def publish_stream(df: DataFrame, topic: str, *, checkpoint: str, writer: str = "stream", trigger: dict | None = None):
    """Each micro-batch of a stream is a batch of the topic."""
    make_topic(df.sparkSession, topic)
    sink = df.writeStream.foreachBatch(lambda rows, batch_id: publish(rows, topic, batch_id, writer) and None)
    return sink.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _rows_of(spark: SparkSession, topic: str, schema: T.StructType | None, attempts: list[str]) -> DataFrame:
    if not attempts:
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*[f"{topic}/data/{a}" for a in sorted(attempts)])


def published(spark: SparkSession, topic: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows of a topic; without ``schema`` its files tell it. The driver lists one name per batch."""
    entries = spark.read.schema(_ENTRY).json(f"{topic}/log")
    return _rows_of(spark, topic, schema, [r["attempt"] for r in entries.select("attempt").collect()])


def published_counts(spark: SparkSession, topic: str) -> DataFrame:
    """Sums of what was counted when the batches were written: ``outcome`` and ``payloads``.

    The entries of the log hold them, so that each batch counts once, and no row of the topic is read.
    """
    entries = spark.read.schema(_COUNTED).json(f"{topic}/log")
    counts = entries.select(F.explode("counts").alias("outcome", "n"))
    return counts.groupBy("outcome").agg(F.sum("n").alias("payloads"))


def last_published(spark: SparkSession, topic: str, up_to: int, writer: str = "batch") -> int:
    """The greatest number, ``up_to`` at most, of the batches of a writer that are in the topic; -1 if there is none."""
    make_topic(spark, topic)
    names = [n.removeprefix(f"{writer}-").removesuffix(".json") for n in child_names(spark, f"{topic}/log") if n.startswith(f"{writer}-")]
    return max((int(n) for n in names if n.isdecimal() and int(n) <= up_to), default=-1)


def remove_leftovers(spark: SparkSession, topic: str, writer: str) -> int:
    """Remove the files of attempts that were never published, of a writer that is not running; returns how many."""
    entries = spark.read.schema(_ENTRY).json(f"{topic}/log").select("attempt")
    known = {r["attempt"] for r in entries.collect()}
    lost = [a for a in child_names(spark, f"{topic}/data") if a.startswith(f"{writer}-") and a not in known]
    for attempt in lost:
        remove_dir(spark, f"{topic}/data/{attempt}")
    return len(lost)


def _entries(spark: SparkSession, topic: str, batch_limit: int | None) -> DataFrame:
    make_topic(spark, topic)
    reader = spark.readStream.schema(_ENTRY)
    if batch_limit:
        reader = reader.option("maxFilesPerTrigger", batch_limit)
    return reader.json(f"{topic}/log")


def follow(
    spark: SparkSession,
    topic: str,
    schema: T.StructType,
    work: Work,
    *,
    checkpoint: str,
    batch_limit: int | None = None,
    trigger: dict | None = None,
):
    """Start a stream that calls ``work(rows, batch_id)`` with what was published since the batch before.

    ``batch_limit`` bounds the published batches taken at a time. ``work`` is called again with the same
    rows and number if it, or the stream, failed before: it should replace or publish its output by that number.
    """

    def handed(entries: DataFrame, batch_id: int) -> None:
        attempts = [r["attempt"] for r in entries.select("attempt").collect()]
        work(_rows_of(spark, topic, schema, attempts), batch_id)

    stream = _entries(spark, topic, batch_limit).writeStream.foreachBatch(handed)
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _new_spans(spark: SparkSession, topic: str, entries: DataFrame, start: int) -> DataFrame:
    """The files of new entries, laid end to end in the order of writer, batch and file from place ``start`` on.

    One row per file of the micro-batch is numbered in one task; limit the batches taken at a time if they are many.
    """
    listed = entries.collect()
    if not listed:
        return spark.createDataFrame([], _SPAN)
    files = spark.read.parquet(*[f"{topic}/data/{r['attempt']}" for r in listed])
    counts = files.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    attempt = F.element_at(F.split("path", "/"), -2)
    named = spark.createDataFrame(listed, _ENTRY).withColumnRenamed("attempt", "_attempt")
    order = Window.orderBy("writer", "batch", "path").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(order), F.lit(0)) + start
    placed = counts.join(F.broadcast(named), attempt == F.col("_attempt"))
    return placed.select("path", first.cast("long").alias("first"), F.lit(0).cast("long").alias("row"), "n")


def _cut(spans: DataFrame, start: int, end: int) -> DataFrame:
    """The parts of spans with places from ``start`` up to ``end``."""
    first = F.greatest("first", F.lit(start))
    last = F.least(F.col("first") + F.col("n"), F.lit(end))
    parts = spans.select("path", first.alias("first"), (F.col("row") + first - F.col("first")).alias("row"), (last - first).alias("n"))
    return parts.filter("n > 0")


def _records(spark: SparkSession, spans: DataFrame, schema: T.StructType, place: str) -> DataFrame:
    """The records of spans, with their ``place`` in the topic."""
    known = spans.collect()  # the files that one demand touches
    if not known:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(place, T.LongType())]))
    files = spark.read.schema(schema).parquet(*sorted({r["path"] for r in known}))
    named = files.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    wanted = F.broadcast(spark.createDataFrame(known, _SPAN))
    inside = (F.col("_path") == F.col("path")) & F.col("_row").between(F.col("row"), F.col("row") + F.col("n") - 1)
    found = named.join(wanted, inside).withColumn("_at", F.col("first") + F.col("_row") - F.col("row"))
    return found.select(*[files[c] for c in schema.fieldNames()], F.col("_at").alias(place))


def _demand(entries: DataFrame, batch_id: int, *, topic: str, schema: T.StructType, work: Work, n: int, carry: str, place: str, together: int) -> None:
    spark = entries.sparkSession
    open_ = read_carry(spark, carry, batch_id - 1, _SPAN)
    start, end = open_.agg(F.min("first"), F.max(F.col("first") + F.col("n"))).first()
    if end is None:
        # nothing is open: all records so far were handed over, in whole micro-batches
        end = start = _handed(spark, carry, batch_id - 1)
    spans = open_.unionByName(_new_spans(spark, topic, entries, end))
    spans = materialize(spans, "spans", f"{carry}/scratch/spans")
    end = spans.agg(F.max(F.col("first") + F.col("n"))).first()[0] or end
    for k in range(start // n, end // n, together):
        after = min(k + together, end // n)
        work(_records(spark, _cut(spans, k * n, after * n), schema, place), after - 1)
    whole = end // n * n
    write_carry(_cut(spans, whole, end), carry, batch_id)
    write_carry(spark.createDataFrame([(whole,)], "handed long"), f"{carry}/handed", batch_id)


def _handed(spark: SparkSession, carry: str, batch_id: int) -> int:
    row = read_carry(spark, f"{carry}/handed", batch_id, T.StructType([T.StructField("handed", T.LongType())])).first()
    return row[0] if row else 0


def follow_records(
    spark: SparkSession,
    topic: str,
    schema: T.StructType,
    work: Work,
    n: int = 5,
    *,
    checkpoint: str,
    place: str = "place",
    batch_limit: int | None = None,
    trigger: dict | None = None,
    together: int = 1,
):
    """Start a stream that calls ``work(records, k)`` with records ``k * n`` up to ``(k + 1) * n`` of a topic, in turn.

    Every call has exactly ``n`` records; what is left over waits for more, or for ``last_records`` once the topic has ended.
    With ``together``, a call has up to so many of the whole micro-batches that are there, and ``k`` is the number of the last.
    The records have their ``place`` in the topic: batches in the order they were found, then writer, batch, file
    and row. A call that failed is made again with the same records and the same number, and so may some calls
    before it: ``work`` should replace or publish its output by that number.
    """
    handed = partial(_demand, topic=topic, schema=schema, work=work, n=n, carry=f"{checkpoint}/carry", place=place, together=together)
    stream = _entries(spark, topic, batch_limit).writeStream.foreachBatch(handed)
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def last_records(spark: SparkSession, schema: T.StructType, work: Work, n: int = 5, *, checkpoint: str, place: str = "place") -> bool:
    """Call ``work`` with the records left over, fewer than ``n``, of a topic that has ended; False if there are none.

    The stream must have stopped. It can be started again, and will then hand over these records once more, in a whole
    micro-batch of the same number.
    """
    if not has_child(spark, checkpoint, "carry"):
        return False
    spans = last_carry(spark, f"{checkpoint}/carry")
    start = spans.agg(F.min("first")).first()[0]
    if start is None:
        return False
    work(_records(spark, spans, schema, place), start // n)
    return True
