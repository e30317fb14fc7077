"""Session settings that the jobs in this package are written for."""

from __future__ import annotations

from collections.abc import Iterable
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A model is called on small batches, and texts can be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    # Nine request folders are written from one pass without sorting the texts.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


# A shuffled partition of this size, uncompressed several times as large, fits an executor core.
PARTITION_BYTES = 128 << 20


def shuffle_partitions(input_bytes: int, least: int = 200) -> int:
    """How many shuffle partitions the input needs; adaptive execution merges small ones."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def build_session(app: str = "triptych", master: str | None = None, input_bytes: int = 0,
                  **extra: str) -> SparkSession:
    """A session with SETTINGS, sized for the input; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes)), **SETTINGS}
    settings |= {k.replace("__", "."): v for k, v in extra.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def send_code(packages: Iterable[ModuleType]) -> None:
    """Have functions of these packages sent to the Python workers with the jobs.

    Without this, every executor must be able to import the packages, for
    instance by `--py-files`.
    """
    for package in packages:
        cloudpickle.register_pickle_by_value(package)
