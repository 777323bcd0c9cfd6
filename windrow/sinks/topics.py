"""Writing topics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from windrow.operators.metrics import invalid_metrics, valid_metrics

# Writer settings for Kafka.
KAFKA_WRITER = {"kafka.acks": "all"}


def topic_sink(
    df: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None
) -> StreamingQuery | None:
    """Append to a topic directory.

    A stream records its source offsets in ``checkpoint`` after each batch, and the file sink makes
    a repeated batch replace itself: no row is lost or doubled by a restart. A batch table has no
    offset to record and is appended.
    """
    if not df.isStreaming:
        df.write.mode("append").parquet(path)
        return None
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder")
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def route_sink(tagged: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write validated metrics to their two topics in one pass, and return both.

    The tag becomes a folder, so that each topic reads its own files only. Two separate writes would
    flatten and validate everything twice.
    """
    tagged.write.mode("append").partitionBy("is_valid").parquet(path)
    table = tagged.sparkSession.read.schema(tagged.schema).parquet(path)
    return valid_metrics(table), invalid_metrics(table)


def spread(df: DataFrame, n: int) -> DataFrame:
    """Even out the rows over ``n`` partitions, whatever their key."""
    return df.repartition(n)


def key_bytes(number: Column) -> Column:
    """A 32-bit number as four bytes, most significant first."""
    wide = F.lpad(F.hex(number.cast("int").cast("bigint")), 16, "0")
    return F.unhex(F.substring(wide, 9, 8))


def kafka_frame(df: DataFrame, value: str = "payload", key: str | None = None) -> DataFrame:
    """The key and value columns that the Kafka writer takes.

    Without ``key``: NULL key and the value as bytes. With it: the number as four bytes, most
    significant first, and the value as text.
    """
    if key is None:
        return df.select(
            F.lit(None).cast("binary").alias("key"), F.col(value).cast("binary").alias("value")
        )
    return df.select(
        key_bytes(F.col(key)).alias("key"), F.col(value).cast("string").alias("value")
    )


def kafka_writer_options(topic: str, servers: str) -> dict[str, str]:
    """Writer options: one topic, and a record counts when all replicas have it."""
    return {**KAFKA_WRITER, "kafka.bootstrap.servers": servers, "topic": topic}


def kafka_sink(
    df: DataFrame, topic: str, servers: str, checkpoint: str | None = None, trigger: dict | None = None
) -> StreamingQuery | None:
    """Write key/value rows to Kafka. Needs the spark-sql-kafka package on the cluster.

    A batch that is run again is written again: readers may see its records twice.
    """
    options = kafka_writer_options(topic, servers)
    if not df.isStreaming:
        df.write.format("kafka").options(**options).save()
        return None
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder")
    writer = df.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
