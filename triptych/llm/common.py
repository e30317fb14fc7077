"""What several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triptych.functions.text import exact

# What separates words, and a word, in Java and Python regular expressions.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Texts that a Python function works on at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; NULL is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes together, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def one_row_each(docs: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """For each id and `text_hash` (xxhash64 of the text) in `chosen`, one such row of `docs`, with its columns."""
    keys = ["__key", "__hash"]

    def keyed(frame: DataFrame, text_hash: Column) -> DataFrame:
        return frame.withColumns({"__key": F.coalesce(F.col(id_column).cast("string"), F.lit("")), "__hash": text_hash})

    rows = keyed(docs, F.xxhash64(whole_text(text_column)))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__hash"))).filter("__n = 1")
    return rows.join(keyed(chosen, F.col("text_hash")).select(*keys), keys, "left_semi").select(
        *map(exact, docs.columns))
