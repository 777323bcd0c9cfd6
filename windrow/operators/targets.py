"""Spread rows over targets and count them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators.positions import with_position


def deal_targets(placed: DataFrame, targets: list | int) -> DataFrame:
    """Give each row that has its position its target, in turn. A number stands for 0, 1, ..."""
    targets = list(range(targets)) if isinstance(targets, int) else targets
    turn = (F.col("pos") % len(targets)).cast("int")
    return placed.withColumn("target", F.get(F.array(*[F.lit(t) for t in targets]), turn))


def assign_targets(df: DataFrame, targets: list | int, *, order_by: list[str]) -> DataFrame:
    """Give each row its target, in turn, in the order of ``order_by``."""
    return deal_targets(with_position(df, order_by), targets)


def hits_per_target(df: DataFrame, targets: DataFrame | list, col: str = "target") -> DataFrame:
    """Rows per target. Every target of ``targets`` (a table or a list) is listed, also with no hits.

    Targets that are not among them, and NULL, have lines of their own, so that the hits add up to the rows.
    """
    if isinstance(targets, list):
        field = T.StructField(col, df.schema[col].dataType)
        targets = df.sparkSession.createDataFrame([(t,) for t in targets], T.StructType([field]))
    none = targets.select(col, F.lit(0).cast("bigint").alias("hits"))
    hits = df.groupBy(col).agg(F.count("*").alias("hits"))
    return none.unionByName(hits).groupBy(col).agg(F.sum("hits").alias("hits"))
