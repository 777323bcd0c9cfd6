"""The whole dataflow on a stream of payloads."""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators.codecs import carried_names, observe_outcomes, observed_outcomes, split_decoded
from windrow.operators.metrics import invalid_metrics, metrics_of, valid_metrics, validate
from windrow.plans.pipeline import (
    INVALID,
    METRICS,
    READINGS,
    ROTOR,
    ROTOR_METRIC,
    VALID,
    faults_of,
    rotor_topic,
    tag_payloads,
)
from windrow.schemas import SENSOR_DATA
from windrow.sinks.lines import invalid_lines, valid_lines
from windrow.sinks.topics import topic_sink
from windrow.sources.topics import topic_source
from windrow.storage import has_child, make_dir, write_part
from windrow.streaming.commit_log import (
    follow_records,
    last_published,
    last_records,
    publish,
    published,
    published_counts,
)
from windrow.streaming.windows import read_windows, stream_count_windows, window_batch

AVERAGES = "averages"
REJECTS = "rejects"
VALID_LINES = "valid-log"
INVALID_LINES = "invalid-log"
# Who writes the topics of a fused run.
PIPELINE = "pipeline"
# Payloads that ingest_records decodes in one go, if their micro-batches are not larger.
AT_ONCE = 5_000_000


def ingest_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    out: str,
    checkpoint: str,
    batch_limit: int = 5,
    ingress: str = "stream",
    col: str = "payload",
    record: T.StructType = SENSOR_DATA,
):
    """``ingest_payloads`` of a payload topic in ``path``, ``batch_limit`` files at a time, until all of it is done."""
    payloads = topic_source(spark, path, schema, batch_limit=batch_limit)
    return ingest_payloads(payloads, out=out, checkpoint=checkpoint, ingress=ingress, col=col, record=record)


def ingest_payloads(
    payloads: DataFrame,
    *,
    out: str,
    checkpoint: str,
    ingress: str = "stream",
    col: str = "payload",
    record: T.StructType = SENSOR_DATA,
    trigger: dict | None = None,
):
    """Decode any stream of payloads, such as ``kafka_source``, and append to a topic.

    Each micro-batch is decoded once. Readings go to ``out``, rejects (raw payload, reason) to
    ``rejects_of(out)/batch=<id>``. A batch that is run again replaces its own files in both.
    """
    spark = payloads.sparkSession
    if has_child(spark, out, "_spark_metadata"):
        raise ValueError(f"{out} was written by a file sink, whose readers would not see new batches: name a new folder")
    make_dir(spark, out)  # readable also before the first batch

    def work(batch: DataFrame, batch_id: int) -> None:
        tagged = tag_payloads(batch, ingress, col, record).persist()
        try:
            readings, rejects = split_decoded(tagged, col)
            rejects.write.mode("overwrite").parquet(f"{rejects_of(out)}/batch={batch_id}")
            write_part(readings, out, f"batch-{batch_id:012d}")
        finally:
            tagged.unpersist()

    writer = payloads.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_records(
    spark: SparkSession,
    topic: str,
    schema: T.StructType,
    *,
    out: str,
    checkpoint: str,
    records: int = 5,
    ingress: str = "stream",
    col: str = "payload",
    record: T.StructType = SENSOR_DATA,
    ended: bool = False,
    at_once: int = AT_ONCE,
) -> None:
    """Decode a topic with a commit log, in micro-batches of ``records`` payloads, into two such topics.

    Takes what is there now and returns. Micro-batch ``k`` holds payloads ``k * records`` and on; the readings in ``out`` and
    the rejects in ``rejects_of(out)`` keep the payload's ``place``, of which ``place div records`` is the micro-batch.
    Whole micro-batches are decoded together, up to ``at_once`` payloads (or one micro-batch) in one go, and become one
    batch of both topics, under the number of the last of them: jobs and files do not grow with the number of micro-batches.
    Payloads that do not fill a micro-batch wait for the next call, unless the topic has ``ended``.
    """

    def unpublished(tagged: DataFrame, target: str, k: int) -> DataFrame:
        """Without micro-batches that are in ``target``: a run that took fewer at once may have failed after them."""
        return tagged.filter(F.col("place") >= (last_published(spark, target, k) + 1) * records)

    def work(payloads: DataFrame, k: int) -> None:
        tagged = tag_payloads(payloads, ingress, col, record).persist()
        try:
            publish(split_decoded(unpublished(tagged, out, k), col)[0], out, k)
            rejects = rejects_of(out)
            _publish_rejects(unpublished(tagged, rejects, k), rejects, k, ingress, col, record)
        finally:
            tagged.unpersist()

    together = max(1, at_once // records)
    follow_records(spark, topic, schema, work, records, checkpoint=checkpoint, together=together).awaitTermination()
    if ended:
        last_records(spark, schema, work, records, checkpoint=checkpoint)


def _publish_rejects(tagged, topic, batch_id, ingress, col, record, writer="batch") -> None:
    """Publish the rejects of decoded payloads; the pass that writes them counts the payloads per outcome."""
    seen = Observation()
    rejects = split_decoded(observe_outcomes(tagged, faults_of(ingress, record), seen), col)[1]
    publish(rejects, topic, batch_id, writer, lambda: observed_outcomes(seen))


def rejects_of(out: str) -> str:
    """Where ``ingest_stream`` puts what it cannot decode: beside the topic, with a column ``batch``."""
    return f"{out.rstrip('/')}-{REJECTS}"


def _fused(
    ingress: str, out: str, checkpoint: str, order_by: list[str], n: int, col: str, record: T.StructType, lines: bool
):
    order = carried_names(order_by, record)

    def work(batch: DataFrame, batch_id: int) -> None:
        tagged = tag_payloads(batch.select(*order_by, col), ingress, col, record).persist()
        try:
            readings = split_decoded(tagged, col)[0]
            checked = validate(metrics_of(readings, record, keep=order))
            topics = {
                READINGS: readings,
                VALID: valid_metrics(checked),
                INVALID: invalid_metrics(checked),
                ROTOR: valid_metrics(validate(metrics_of(readings, record, [ROTOR_METRIC], keep=order))),
            }
            if lines:
                topics[VALID_LINES] = valid_lines(topics[VALID])
                topics[INVALID_LINES] = invalid_lines(topics[INVALID])

            def write(name: str) -> None:
                if name == REJECTS:
                    _publish_rejects(tagged, f"{out}/{REJECTS}", batch_id, ingress, col, record, PIPELINE)
                else:
                    publish(topics[name], f"{out}/{name}", batch_id, PIPELINE)

            # side by side, so that the tail of one write does not hold up the next
            with ThreadPoolExecutor(len(topics) + 1) as pool:
                list(pool.map(inheritable_thread_target(batch.sparkSession)(write), [*topics, REJECTS]))
            window_batch(
                topics[ROTOR],
                batch_id,
                out=f"{out}/{AVERAGES}",
                carry=f"{checkpoint}/carry",
                n=n,
                order_by=order,
            )
        finally:
            tagged.unpersist()

    return work


def run_stream(
    payloads: DataFrame,
    *,
    out: str,
    checkpoint: str,
    order_by: list[str],
    ingress: str = "avro",
    n: int = 5,
    col: str = "payload",
    materialize: bool = False,
    trigger: dict | None = None,
    record: T.StructType = SENSOR_DATA,
    lines: bool = False,
) -> list:
    """Run the dataflow on a stream; returns its queries.

    Fused (the default): one query decodes each micro-batch once and publishes it in every topic,
    ``out/<topic>``, whose commit log others may follow meanwhile; see ``read_topic``. With ``materialize``, each step is a query of its own that reads the
    topic before it, so that steps can be stopped and scaled apart.

    ``record`` is the schema of Avro payloads, readings or metrics. ``lines`` adds the topics of log lines.
    ``payload_outcomes`` has the count of payloads kept and rejected by a fused run.

    With the default trigger (all that is there now) the queries have ended when this returns.
    A later call with the same folders goes on where this one stopped, with no gap and no repeat.
    """
    spark = payloads.sparkSession
    trigger = trigger or {"availableNow": True}
    queries = []

    def started(query):
        queries.append(query)
        if "availableNow" in trigger:
            query.awaitTermination()

    if not materialize:
        work = _fused(ingress, out, checkpoint, order_by, n, col, record, lines)
        writer = payloads.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        started(writer.trigger(**trigger).start())
        return queries

    schemas, order = {}, carried_names(order_by, record)

    def hop(name: str, rows: DataFrame) -> None:
        schemas[name] = rows.schema
        started(topic_sink(rows, f"{out}/{name}", f"{checkpoint}/{name}", trigger))

    def topic(name: str) -> DataFrame:
        make_dir(spark, f"{out}/{name}")  # the step before may not have written yet
        return topic_source(spark, f"{out}/{name}", schemas[name])

    readings, rejects = split_decoded(tag_payloads(payloads.select(*order_by, col), ingress, col, record), col)
    hop(READINGS, readings)
    hop(REJECTS, rejects)
    hop(METRICS, metrics_of(topic(READINGS), record, keep=order))
    checked = validate(topic(METRICS))
    hop(VALID, valid_metrics(checked))
    hop(INVALID, invalid_metrics(checked))
    hop(ROTOR, rotor_topic(topic(VALID)))
    if lines:
        hop(VALID_LINES, valid_lines(topic(VALID)))
        hop(INVALID_LINES, invalid_lines(topic(INVALID)))
    started(
        stream_count_windows(
            topic(ROTOR),
            n,
            order_by=order,
            out=f"{out}/{AVERAGES}",
            checkpoint=f"{checkpoint}/{AVERAGES}",
            trigger=trigger,
        )
    )
    return queries


def read_topic(spark: SparkSession, out: str, name: str, *, materialize: bool = False) -> DataFrame:
    """What a run has written to a topic so far."""
    path = f"{out}/{name}"
    return spark.read.parquet(path) if materialize else published(spark, path)


def payload_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """Payloads per outcome of a fused run so far: those kept, and the rejects of each reason."""
    return published_counts(spark, f"{out}/{REJECTS}")


def averages(
    spark: SparkSession,
    out: str,
    checkpoint: str,
    n: int = 5,
    *,
    materialize: bool = False,
    emit_partial: bool = True,
) -> DataFrame:
    """The averages of a run; ``emit_partial`` once the stream has ended."""
    state = f"{checkpoint}/{AVERAGES}" if materialize else checkpoint
    return read_windows(spark, f"{out}/{AVERAGES}", state, n, emit_partial)
