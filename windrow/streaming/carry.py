"""What one micro-batch leaves to the next, kept beside the checkpoint on shared storage."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from windrow.storage import child_names, remove_dir

_BATCH = "batch="

#: Folder beside the batches for state of which a batch writes only what it changed, see ``change_log``.
CHANGES = "changes"


def read_carry(spark: SparkSession, carry: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The rows left by ``batch_id``, none by the batch before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(f"{carry}/{_BATCH}{batch_id}")
    except AnalysisException as missing:
        raise RuntimeError(f"{carry} does not hold the state after batch {batch_id}") from missing


def write_carry(rows: DataFrame, carry: str, batch_id: int) -> None:
    """Keep the rows for the next batch. A batch that is run again replaces its own.

    Only the batch before is ever read again, so older ones are removed.
    """
    rows.write.mode("overwrite").parquet(f"{carry}/{_BATCH}{batch_id}")
    remove_dir(rows.sparkSession, f"{carry}/{_BATCH}{batch_id - 2}")


def last_carry(spark: SparkSession, carry: str) -> DataFrame:
    """The rows left by the last batch of a stream."""
    names = [n for n in child_names(spark, carry) if n.startswith(_BATCH)]
    last = max(int(n.removeprefix(_BATCH)) for n in names)
    return spark.read.parquet(f"{carry}/{_BATCH}{last}")
