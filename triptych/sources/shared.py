"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_folder: str | None = None
_run_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local-mode session may go without the setting: it then gets one
    temporary folder per process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="triptych-")
    return _local_folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, or in that of the run, that nothing else uses."""
    folder = _run_folders[-1] if _run_folders else shared_folder(spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Have what is written in between lie in one folder, and drop it at the end.

    Frames that were made in between are read from there, so what is to stay has
    to be written to its own place before the end. Without this, intermediate
    tables stay in the shared folder.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    _run_folders.append(folder)
    try:
        yield folder
    finally:
        _run_folders.remove(folder)
        _file_system(spark, folder).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have each query that runs in between drop its shuffle files when it ends.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_FILE_CLEANUP)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_FILE_CLEANUP, before)


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write `df` once and read it back; `codec` is Parquet's, if not the session's.

    Rows that come from a paid or random model must not be computed again when
    an executor is lost or when the frame is used twice.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing `path`."""
    return _file_system(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
