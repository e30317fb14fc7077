"""Results that are replaced in one step: written aside, then named by a new pointer file.

`mode("overwrite")` deletes the old result before the new one is written, so a job that
fails half-way leaves neither. Here each write goes to a version folder of its own; only
when Spark has committed it is a pointer file created, named by a number above those of
all pointers before it, whose text names the version. A reader takes the version of the
highest pointer, so it sees the old result or the new one, never a part. Creating a file
that must not exist yet is one step on every Hadoop file system; two writers that race
for the same number fail one of them instead of mixing. Versions that no pointer names
any longer are deleted after the swap, the one before the newest kept for readers that
are still on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_pointer-"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the pointers under `path`, highest last."""
    files, jvm = _fs(spark, path)
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not files.exists(root):
        return []
    found = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(POINTER) and name[len(POINTER):].isdigit():
            stream = files.open(status.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found.append((int(name[len(POINTER):]), text.strip()))
    return sorted(found)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the result under `path` now, or None before the first swap."""
    pointers = _pointers(spark, path)
    return f"{path.rstrip('/')}/{pointers[-1][1]}" if pointers else None


def write_swapped(df: DataFrame, path: str, file_format: str = "parquet", **options: str) -> str:
    """Write `df` as the new result under `path` and swap it in; the version folder written.

    If the job fails, the pointer is not moved: readers keep the old result, and the
    half-written version is left for `clean`. Options go to Spark's writer.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    df.write.format(file_format).options(**options).save(folder)
    files, jvm = _fs(spark, path)
    number = (_pointers(spark, path) or [(0, "")])[-1][0] + 1
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}{number:012d}")
    stream = files.create(pointer, False)  # fails if another writer took the number
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    clean(spark, path)
    return folder


def clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the pointers before the `keep` newest, and version folders none of those names.

    For one writer at a time: a version that another job is writing now is not yet named.
    """
    pointers = _pointers(spark, path)
    kept = {version for _, version in pointers[-keep:]}
    old = {f"{POINTER}{number:012d}" for number, _ in pointers[:-keep]}
    files, jvm = _fs(spark, path)
    for status in files.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = status.getPath().getName()
        if name in old or (name.startswith("v-") and name not in kept):
            files.delete(status.getPath(), True)


def read_swapped(spark: SparkSession, path: str, file_format: str = "parquet", schema: str | None = None,
                 **options: str) -> DataFrame:
    """The current result under `path`; an error before the first swap."""
    folder = current_version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no result has been swapped in at {path}")
    reader = spark.read.format(file_format).options(**options)
    return (reader.schema(schema) if schema else reader).load(folder)
