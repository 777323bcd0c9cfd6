"""Intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``."""

import tempfile
import threading
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_local_dir = None
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach. Only a local session may fall back to a temporary one."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="windrow-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own for an intermediate table; the innermost :func:`intermediates` removes it."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/windrow/{app}/{label}-{uuid.uuid4().hex}"
    if stack := getattr(_scopes, "stack", None):
        stack[-1].paths.append(path)
    return path


class Scope:
    """Paths that were handed out inside one :func:`intermediates` block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def release(self) -> None:
        """Remove what has been written so far. Tables that still read it cannot be used any more."""
        while self.paths:
            remove_dir(self.spark, self.paths.pop())

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and remove what it was made of; the table lives on in the surrounding block, if any."""
        path = new_path(self.spark, label)
        self.paths.remove(path)
        df.write.parquet(path)
        outer = _scopes.stack[:-1]
        if outer:
            outer[-1].paths.append(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession):
    """Everything that is materialised inside the block, on this thread, is removed at its end.

    Use the results (write or collect them) before the block ends: they may read what it removes.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    scope = Scope(spark)
    stack.append(scope)
    try:
        yield scope
    finally:
        scope.release()
        stack.remove(scope)


def _file_system(spark: SparkSession, path: str):
    """The file system a path names, and the path in its terms."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def make_dir(spark: SparkSession, path: str) -> None:
    files, folder = _file_system(spark, path)
    files.mkdirs(folder)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package has written, if it is there."""
    files, folder = _file_system(spark, path)
    files.delete(folder, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    files, folder = _file_system(spark, path)
    return [status.getPath().getName() for status in files.listStatus(folder)]


def has_child(spark: SparkSession, path: str, name: str) -> bool:
    files, folder = _file_system(spark, f"{path}/{name}")
    return files.exists(folder)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file from the driver."""
    files, file = _file_system(spark, path)
    out = files.create(file, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file to a name that nobody has taken; False, and nothing is moved, if it is there already."""
    fs = spark._jvm.org.apache.hadoop.fs
    paths = [fs.Path(p) for p in (source, target)]
    context = fs.FileContext.getFileContext(paths[1].toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        context.rename(*paths, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def write_part(df: DataFrame, path: str, name: str) -> None:
    """Add ``df`` to the Parquet files in the folder ``path``, in place of what was added under ``name`` before.

    The files are written in a hidden folder and moved when all are whole, under names that do not
    change if the same rows are added again.
    """
    spark = df.sparkSession
    staged = f"{path}/_staged-{name}"
    df.write.mode("overwrite").parquet(staged)
    parts = sorted(n for n in child_names(spark, staged) if n.startswith("part-"))
    for old in child_names(spark, path):
        if old.startswith(f"{name}-"):
            remove_dir(spark, f"{path}/{old}")
    for i, part in enumerate(parts):
        files, source = _file_system(spark, f"{staged}/{part}")
        _, target = _file_system(spark, f"{path}/{name}-{i:05d}.parquet")
        if not files.rename(source, target):
            raise OSError(f"{source.toString()} could not be moved to {target.toString()}")
    remove_dir(spark, staged)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    The written rows are fixed, so later passes agree with each other even if an executor is
    lost or the plan above was not deterministic, and each pass reads only the columns it needs.
    A ``path`` that is given is overwritten, so that a stream needs room for one batch only.
    """
    mode = "overwrite" if path else "errorifexists"
    path = path or new_path(df.sparkSession, label)
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
