"""Row numbers over a whole table, without one task that sees every row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triptych.sources.shared import materialize

_SLOT, _PART, _BEFORE = "_slot", "_part", "_before"
_PART_BITS = 33


def with_input_ordinal(df: DataFrame, file: str, block: str, name: str = "seg_id") -> DataFrame:
    """Add the 0-based position of each row of a scan, in the order in which it lies in the files.

    `file` and `block` name columns that say where a row was read. Rows of a
    block come one after the other, so a row's place is its distance from the
    first one of its block; what the blocks before have is summed up, one row
    per block. The rows are not shuffled and not written. Blocks are written
    with their lengths: were the files split another way at the second reading,
    a row would miss its block and stop the job.
    """
    placed = df.withColumn(_SLOT, F.monotonically_increasing_id())
    blocks = placed.groupBy(file, block).agg(F.min(_SLOT).alias("_first"), F.count("*").alias("_size"))
    earlier = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(blocks.select(
        F.col(file).alias("_of"), F.col(block).alias("_at"), "_first",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias(_BEFORE)), "blocks")
    joined = placed.join(starts, (F.col(file) == F.col("_of")) & (F.col(block) == F.col("_at")), "left")
    place = F.when(F.col(_BEFORE).isNotNull(), F.col(_BEFORE) + F.col(_SLOT) - F.col("_first")).otherwise(
        F.raise_error(F.lit("the files were split another way at the second reading")).cast("long"))
    return joined.withColumn(name, place).drop("_of", "_at", "_first", _BEFORE, _SLOT)


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "seg_id") -> DataFrame:
    """Add the 0-based position of each row in `order`, which must be unique: rows with equal values stop the job.

    The order is sorted over many partitions and written once, without the other
    columns, each row with its place in its partition. Partition sizes, one row
    per partition, are summed up and added to the places, and the rows get their
    places by a join. Rows of a scan in the order of their files are better
    off with `with_input_ordinal`.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_key{i}" for i in range(len(keys))]
    named = df.withColumns(dict(zip(names, keys, strict=True)))
    placed = materialize(named.select(*names).repartitionByRange(*names).sortWithinPartitions(*names)
                         .withColumn(_SLOT, F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright(_SLOT, _PART_BITS)
    sizes = placed.groupBy(part.alias(_PART)).agg(F.count("*").alias("_size"))
    # At most one row per shuffle partition, so a single task and a broadcast hold it.
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_PART, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias(_BEFORE))
    place = F.col(_SLOT).bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    places = (placed.withColumn(_PART, part).join(F.broadcast(starts), _PART)
              .select(*(F.col(c).alias(f"{c}p") for c in names), (F.col(_BEFORE) + place).alias(name)))
    places = places.groupBy(*(f"{c}p" for c in names)).agg(F.min(name).alias("_least"), F.count("*").alias("_rows"))
    places = places.select(*(f"{c}p" for c in names), F.when(F.col("_rows") == 1, F.col("_least")).otherwise(
        F.raise_error(F.lit("several rows have one place in the order")).cast("long")).alias(name))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}p")) for c in names))
    return named.join(places, same).select(*(c for c in df.columns if c != name), name)
