"""Topics: a directory of parquet files, or a Kafka topic where the connector is installed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a Kafka record as Spark's connector delivers them.
KAFKA_RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# The received-record line and its time format.
RECORD_LINE = "Received message: topic-partition=%s offset=%d timestamp=%s key=%d value=%s"
RECORD_TIME = "HH:mm:ss:SSS z dd MMM yyyy"


def kafka_options(
    topic: str, servers: str, group: str | None = None, batch_limit: int | None = None
) -> dict[str, str]:
    """Reader options: one topic from its start, and a bound on the records per micro-batch."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if group:
        options["kafka.group.id"] = group
    if batch_limit:
        options["maxOffsetsPerTrigger"] = str(batch_limit)
    return options


def kafka_source(spark: SparkSession, topic: str, servers: str, **limits) -> DataFrame:
    """Stream of Kafka records. Needs the spark-sql-kafka package on the cluster."""
    options = kafka_options(topic, servers, **limits)
    return spark.readStream.format("kafka").options(**options).load()


def topic_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    batch_limit: int | None = None,
    batch_bytes: str | None = None,
) -> DataFrame:
    """Stream of a topic directory, oldest files first.

    ``batch_limit`` bounds the files per micro-batch and ``batch_bytes`` their size ("10g"): the
    reader asks for the next part only when the one before is done.
    """
    if batch_limit and batch_bytes:
        raise ValueError("give batch_limit or batch_bytes, not both")
    reader = spark.readStream.schema(schema)
    if batch_limit:
        reader = reader.option("maxFilesPerTrigger", batch_limit)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    return reader.parquet(path)


def topic_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same topic as a batch table."""
    return spark.read.schema(schema).parquet(path)


def int_key(key) -> F.Column:
    """A 4-byte big-endian key as a signed number; NULL for any other length."""
    unsigned = F.conv(F.hex(key), 16, 10).cast("bigint")
    return F.when(
        F.octet_length(key) == 4,
        F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned).cast("int"),
    )


def record_lines(df: DataFrame) -> DataFrame:
    """Topic-partition, offset, formatted time, key and value of Kafka records, and the log line."""
    shown = df.select(
        F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("topic_partition"),
        "offset",
        F.date_format("timestamp", RECORD_TIME).alias("time"),
        int_key(F.col("key")).alias("key"),
        F.make_valid_utf8(F.col("value").cast("string")).alias("value"),
    )
    line = F.format_string(RECORD_LINE, "topic_partition", "offset", "time", "key", "value")
    return shown.withColumn("line", line)
