"""Delimited files whose quoted fields hold line breaks, read in blocks: several tasks per file.

Spark's CSV reader gives a whole file to one task when fields may hold line breaks, since
a task that starts inside a file cannot tell whether it starts inside quotes. Here the
files are read as lines (which Spark splits into blocks), and a line begins a record when
the quotes before it in its file are even:

1. Quote parity per line: the number of `"` in the line, modulo 2 (an escaped quote is
   doubled, so it does not change the parity).
2. A prefix scan over blocks: a task reads a block in order, so the parity before each line of
   it, and the last line that may start a record, are carried along in the task, over small
   numbers and without the texts. Each block's parity is one row; a window over those rows
   per file gives the parity before each block. Only this small table is ordered across
   the file, and it is broadcast.
3. Records glued across line and block ends: a line whose parity before it is even starts a
   record; the others belong to the last start before them, in their block or carried
   from an earlier one (again over the table of blocks). A record of one line is parsed
   where it lies; the lines of the others are grouped by their record and joined. That is
   the only time that texts are shuffled.
4. Each record is parsed by Spark's CSV parser (`from_csv`), with the header of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptych.functions.text import na_to_null
from triptych.operators.headers import trim_headers
from triptych.sources.shared import materialize

_FILE, _BLOCK, _LINE, _HEAD = "_file", "_block", "_line", "_head"


def _along(odd: np.ndarray, line: np.ndarray, held: tuple[int, int, int]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """For lines of a block, the parity before each and the last line so far before which it is 0
    and 1 (-1: none), from what is `held` of the lines before; and what holds after them."""
    parity = (held[0] + np.cumsum(odd)) % 2
    before = np.concatenate([[held[0]], parity[:-1]])
    last = [np.maximum(np.maximum.accumulate(np.where(before == p, line, -1)), held[1 + p]) for p in (0, 1)]
    return np.stack([before, *last], axis=1), (int(parity[-1]), int(last[0][-1]), int(last[1][-1]))


def _carrying(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """`_along` for each block of a task's lines, in their order."""
    block_now, held, top = None, (0, -1, -1), -1
    for file, block, odd, line in batches:
        new = (file != file.shift()) | (block != block.shift())
        edges = [0, *(np.flatnonzero(new.to_numpy()[1:]) + 1).tolist(), len(line)] if len(line) else [0]
        out = np.empty((len(line), 4), np.int64)
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            own = file.iloc[start], block.iloc[start]
            if own != block_now:
                block_now, held, top = own, (0, -1, -1), line.iloc[start]
            out[start:stop, :3], held = _along(odd.to_numpy()[start:stop], line.to_numpy()[start:stop], held)
            out[start:stop, 3] = top
        yield pd.DataFrame(out, columns=["before", "even", "odd", "top"])


def _lines(spark: SparkSession, path: str, beginnings: bool = False) -> DataFrame:
    """The lines of the files, or of their first blocks, with their parity and what `_carrying` finds."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
        (F.col("_metadata.file_size") > F.col("_metadata.file_block_length")).alias("goes_on"),
        F.monotonically_increasing_id().alias(_LINE), F.col("value").alias("text"))
    if beginnings:
        lines = lines.filter(F.col(_BLOCK) == 0)
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    lines = lines.withColumn("odd", (quotes % 2).cast("int"))
    carried = F.pandas_udf(_carrying, "before long, even long, odd long, top long").asNondeterministic()
    return lines.withColumn("_so_far", carried(_FILE, _BLOCK, "odd", _LINE))


def _glued() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(_BLOCK, _LINE, "text")))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")


def record_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the delimited files at `path`: its file, block, line and text, and
    whether it is the first of its file (`_head`).

    Lines end at `\\n`; a `\\r` before it stays in the text, so records are exact. The
    `_line` of a record is its first line's place in the input; they sort in file order
    within a file and block. A final quote left open makes the rest of the file one record.
    """
    lines = _lines(spark, path)
    # The table of blocks: one row each, whatever the size of the files.
    blocks = lines.groupBy(_FILE, _BLOCK).agg(
        (F.sum("odd") % 2).alias("odd_block"), F.min("_so_far.top").alias("top"),
        F.max("_so_far.even").alias("even_last"), F.max("_so_far.odd").alias("odd_last"))
    earlier = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("flip", F.coalesce(F.sum("odd_block").over(earlier), F.lit(0)) % 2)
    # The last start of a block: its last line of even parity before it if the block begins
    # outside quotes, of odd parity if it begins inside; carried into the blocks after it.
    own_last = F.when(F.col("flip") == 0, F.col("even_last")).otherwise(F.col("odd_last"))
    blocks = blocks.withColumn("own_last", F.nullif(own_last, F.lit(-1))).withColumn(
        "carried", F.last("own_last", ignorenulls=True).over(earlier))
    # The first line of a file is the one at its beginning.
    top = F.when(F.col(_BLOCK) == 0, F.col("top"))
    blocks = materialize(blocks.select(_FILE, _BLOCK, "flip", "carried", top.alias("top")), "blocks")
    lines = lines.join(F.broadcast(blocks), [_FILE, _BLOCK], "left")
    # Both readings of the files must split them alike.
    flip = F.coalesce("flip", F.raise_error(F.lit("the blocks of the files changed between two readings")).cast("long"))
    starts = (F.col("_so_far.before") + flip) % 2 == 0
    last = F.nullif(F.when(F.col("flip") == 0, F.col("_so_far.even")).otherwise(F.col("_so_far.odd")), F.lit(-1))
    lines = lines.select(_FILE, _BLOCK, _LINE, "text", "odd", "top", starts.alias("starts"),
                         F.coalesce(last, F.col("carried")).alias("record"))
    # A line that starts a record and leaves the quotes even is a whole record, parsed where it lies.
    single = F.col("starts") & (F.col("odd") == 0)
    head = F.coalesce(F.col("record") == F.col("top"), F.lit(False))
    whole = lines.filter(single).select(_FILE, _BLOCK, _LINE, "text", head.alias(_HEAD))
    parts = lines.filter(~single).groupBy(_FILE, "record").agg(
        F.min(F.struct(_BLOCK, _LINE)).alias("first"), F.max(head).alias(_HEAD), _glued())
    glued = parts.select(_FILE, F.col("first")[_BLOCK].alias(_BLOCK), F.col("record").alias(_LINE), "text", _HEAD)
    return whole.unionByName(glued)


def _headers(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """The first record of each file as `text`, looked for in the first blocks alone if all end there."""
    lines = _lines(spark, path, beginnings=True)
    later = F.col("_so_far.even") > F.col("_so_far.top")
    firsts = lines.groupBy(_FILE).agg(F.max("goes_on").alias("goes_on"), F.count_if(later).alias("later"))
    if not firsts.filter("goes_on and later = 0").isEmpty():
        return records.filter(F.col(_HEAD)).select("text")
    return lines.filter(~later).groupBy(_FILE).agg(_glued()).select("text")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Like `readers.read_table(spark, path)` (quotes `"`, escaped by doubling, fields with line
    breaks, every column text, missing marks as NULL, a row with too many fields stops the
    job, one with too few is filled with NULL), but each file is read by several tasks.

    A record may end in CR LF: the CR is not part of its last field (Spark's whole-file
    reader keeps it there when the file's first line ends in LF alone); inside quotes a CR
    stays. Every file must start with the same header line; one with another stops the job. Empty
    lines between records are skipped, as Spark's reader skips them. The columns `_file`,
    `_block` and `_line` sort the rows as they stand in the files.
    """
    from triptych.sources.readers import _unique_names

    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
    first = spark.read.options(**options, multiLine=True, header=False).csv(path).first()
    if first is None:
        raise ValueError(f"no header in {path}")
    names = _unique_names(list(first))
    records = record_lines(spark, path)
    wider = T.StructType([*(T.StructField(n, T.StringType()) for n in names),
                          T.StructField("_overflow", T.StringType())]).toDDL()
    parsed = F.from_csv(F.regexp_replace("text", "\r$", ""), wider, options)
    if len(_headers(spark, path, records).select(parsed.alias("p")).distinct().collect()) > 1:
        raise ValueError(f"the files of {path} have different headers")
    body = records.filter(~F.col(_HEAD) & (F.regexp_replace("text", "\r$", "") != ""))
    body = body.select("*", parsed.alias("p"))
    # The check is part of a column, not a filter: Spark may evaluate a filter's terms on
    # lines that are no whole record, but a column only on the rows that reach it.
    too_wide = F.col("p._overflow").isNotNull()
    stop = F.raise_error(F.concat(F.lit(f"a row of {path} has more fields than its header: "),
                                  F.substring("text", 1, 80)))
    kept = [na_to_null(F.col("p")[n]).alias(n) for n in names]
    kept[0] = F.when(too_wide, stop.cast("string")).otherwise(na_to_null(F.col("p")[names[0]])).alias(names[0])
    return trim_headers(body.select(*kept, _FILE, _BLOCK, _LINE))
