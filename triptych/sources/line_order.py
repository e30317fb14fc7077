"""Replies without keys: the i-th line of a task's reply files answers its i-th request line.

A scorer that writes one `{"prediction": ...}` per line, in the order of the requests, names
no key. Both file sets are numbered by position without moving their texts: Spark reads
the files as lines, a table of one row per block (file, start) holds its first row id and
its line count, a window over that small table gives each block's offset in its task, and
a line's place is its block's offset plus its distance from the block's first row id.
Keys and predictions are then parsed where they lie; only (task, place, key) and
(task, place, prediction) are joined. A task whose numbers of request and reply lines
differ is void: none of its replies is attached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triptych.functions.text import is_number_text

_GROUP, _FILE, _BLOCK, _ID = "_group", "_file", "_block", "_id"


def numbered_lines(spark: SparkSession, path: str, group: str = "task") -> DataFrame:
    """Every line of the files at `path`: `group` (the partition folder `group=...`, '' if
    there is none), `place` (from 0, in the order of file names and lines within the group)
    and `value` (the line, without its `\\n`). Empty lines count as lines."""
    raw = spark.read.option("lineSep", "\n").text(path)
    named = F.coalesce(F.col(group).cast("string"), F.lit("")) if group in raw.columns else F.lit("")
    lines = raw.select(named.alias(_GROUP), F.col("_metadata.file_path").alias(_FILE),
                       F.col("_metadata.file_block_start").alias(_BLOCK),
                       F.monotonically_increasing_id().alias(_ID), "value")
    # Ids grow by one a row within a task's part of the input, and a block is read by one task.
    blocks = lines.groupBy(_GROUP, _FILE, _BLOCK).agg(F.min(_ID).alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(_GROUP).orderBy(_FILE, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # One row per file block: broadcast, whatever Spark takes its size for, or all lines would be shuffled.
    return lines.join(F.broadcast(blocks), [_GROUP, _FILE, _BLOCK]).select(
        F.col(_GROUP).alias(group), (F.col("offset") + F.col(_ID) - F.col("first")).alias("place"), "value")


def replies_by_order(spark: SparkSession, requests: str, replies: str, keys: Sequence[str] = ("seg_id",),
                     on_bad: str = "fail") -> DataFrame:
    """Long scores (keys, task, prediction) of reply files that hold no keys.

    `requests` are JSON lines with the keys (as `write_requests` writes them), one folder
    per task; `replies` has the same folders, one JSON object with `prediction` a line, in
    the order of the request lines (files in name order). A task whose request and reply
    line counts differ gives no rows, so that `attach_scores` leaves it out. A line
    without a numeric prediction stops the job (`on_bad="fail"`), or is left out
    (`"drop"`): its request then has no score and `attach_scores` leaves the task out.
    Requests that are missing a key keep it NULL.
    """
    if on_bad not in ("fail", "drop"):
        raise ValueError(f"on_bad is 'fail' or 'drop', not {on_bad!r}")
    key_schema = ", ".join(f"`{k}` long" for k in keys)
    asked = numbered_lines(spark, requests).select(
        "task", "place", F.from_json("value", key_schema).alias("k")).select(
        "task", "place", *(F.col("k")[k].alias(k) for k in keys))
    said = numbered_lines(spark, replies).select(
        "task", "place", "value", F.from_json("value", "prediction string")["prediction"].alias("text"))
    counts = asked.groupBy("task").count().join(said.groupBy("task").count().withColumnRenamed("count", "said"),
                                                "task").filter(F.col("count") == F.col("said")).select("task")
    numeric = F.coalesce(is_number_text(F.col("text")), F.lit(False))
    if on_bad == "drop":
        said = said.filter(numeric).select("task", "place", F.col("text").try_cast("double").alias("prediction"))
    else:
        bad = F.raise_error(F.concat(F.lit("not a prediction: "), F.substring("value", 1, 80))).cast("double")
        said = said.select("task", "place", F.when(numeric, F.col("text").try_cast("double")).otherwise(bad)
                           .alias("prediction"))
    return asked.join(F.broadcast(counts), "task", "left_semi").join(said, ["task", "place"]).select(
        *keys, "task", "prediction")
