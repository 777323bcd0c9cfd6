"""What several operators of this package share."""

import io
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.storage import shared_dir, write_bytes

#: Fixed: what separates words, and what the exact dedup folds to one space.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than this share of all rows is hot; there can be no more such keys than its inverse.
HOT_SHARE = 1 / 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def attach(rows: DataFrame, groups: DataFrame, on: list[str], total: int, how: str = "left", count: str = "n_rows"):
    """Join ``rows`` with ``groups`` (one row per key, ``count`` rows of ``rows`` in each), hot keys apart.

    A key that holds over 1/256 of the ``total`` rows is not shuffled: there are at most 256 of them,
    so their groups are broadcast. Null keys must be replaced before.
    """
    hot = groups.filter(F.col(count) > total * HOT_SHARE)
    cold = groups.filter(F.col(count) <= total * HOT_SHARE)
    of_hot = rows.join(F.broadcast(hot), on, "inner")
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return of_hot.unionByName(others)


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few; else the join shuffles it."""
    return F.broadcast(df) if rows <= most else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this application the modules of this package, wherever they were started.

    The archive lies in the shared folder as long as the application needs it, for executors that come later too.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = f"{shared_dir(spark)}/windrow/{app}/{root.name}-modules.zip"
    write_bytes(spark, path, packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def on_workers(query):
    """A query or stage whose functions run in Python workers too."""

    @wraps(query)
    def shipped(spark: SparkSession, *args):
        ship_package(spark)
        return query(spark, *args)

    return shipped
