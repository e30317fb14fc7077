"""Mixing sources to target weights, with budgets cut exactly to the word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triptych.functions.text import exact
from triptych.llm.common import WORD, whole_text
from triptych.sources.shared import materialize

# Documents of one source, at most about so many, whose order is settled in one group.
RANGE_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _source(column: str) -> Column:
    """The source without NULL; a source that is NULL is empty, any other begins with a sign."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def source_targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """One row per `source`: `source_size` and `target`.

    `sizes` has `source` (as `_source` has it) and `size`. Targets share the total by
    weight, and stop at `epochs` times their source. Sources are filled in the order of
    limit over weight: those before the level at which the rest can be shared have reached
    their limit. This orders one row per source.
    """
    total = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    by_name = Window.orderBy(F.col("source") == "", "source")
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights))
    total = total.select("source", "source_size", weight.cast("long").alias("weight"),
                         (F.col("source_size") * epochs).alias("most"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    total = total.withColumn("level", left / F.sum("weight").over(onwards))
    # The first source that stays under its limit gives the level for all that follow.
    share = F.col("level") * F.col("weight")
    total = total.withColumn("level", F.first(F.when(share < F.col("most"), F.col("level")), ignorenulls=True)
                             .over(everything))
    most = F.col("most").cast("double")
    return total.select("source", "source_size", F.least(F.coalesce(share, most), most).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: int = 42,
        id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: its id, `size`, `source_size`, `target`, `taken`, `source` and
    `text_hash`, the last two for `take`.

    Sizes are words. Sources by code point, NULL last, get the `weights` in turn and share
    the size of all documents; a target stops at `epochs` times its source. Within a source,
    documents are in the order of a hash of seed and id, as often as epochs are needed, and
    the source is cut at its target, rounded to whole words: the document at the cut is
    taken in part. So `taken` is between 0 and `epochs` times `size`.

    The hashes are dealt into ranges of equal width, so a range of a source has about
    `range_rows` documents at most however large the source is. The words before a range are
    a prefix sum over the ranges of the source; those within it, over its documents.

    NULL and blank texts have size 0 and take nothing. Rows with one id are ordered by size
    and `text_hash` (xxhash64 of the text); equal rows are each taken in turn. Without
    documents the result is empty. Other columns are not carried.
    """
    text = whole_text(text_column)
    spot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")).cast("binary"))
    rows = materialize(docs.select(
        F.col(id_column).alias("key"), _source(source_column).alias("source"), n_words(text).alias("size"),
        spot.alias("spot"), F.xxhash64(text).alias("text_hash")), "sizes")
    ranges = -(-rows.count() // range_rows)
    # 13 hexadecimal digits are a fraction of 2^52.
    fraction = F.conv(F.substring("spot", 1, 13), 16, 10).cast("long") / (1 << 52)
    rows = rows.withColumn("range", F.floor(fraction * ranges))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "range", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    heads = sums.join(source_targets(rows, weights, epochs), "source")
    inside = Window.partitionBy("source", "range").orderBy(
        "spot", F.col("key").asc_nulls_last(), "size", "text_hash")
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    budget = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - full * F.col("source_size") - F.col("earlier") - F.col("before")
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).join(heads, ["source", "range"]).select(
        F.col("key").alias(id_column), "size", "source_size", "target",
        (full * F.col("size") + F.least(F.greatest(left, F.lit(0)), F.col("size"))).alias("taken"),
        "source", "text_hash")


def take(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         source_column: str = "source", length_column: str = "n_chars") -> DataFrame:
    """The rows of `docs` as often as `mixed`, the result of `mix` on them, takes them.

    A document that is taken in part comes last as its first words, joined by one space,
    with `length_column` counted anew; there is at most one for each source. A document
    that takes nothing is left out. Equal rows are numbered, and so are their shares.
    """
    columns = docs.columns
    keys = ["__key", "__source", "__hash"]
    text = whole_text(text_column)
    rows = docs.withColumns({"__key": F.coalesce(F.col(id_column).cast("string"), F.lit("")),
                             "__source": _source(source_column), "__hash": F.xxhash64(text)})
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__hash")))
    shares = mixed.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("__key"),
                          F.col("source").alias("__source"), F.col("text_hash").alias("__hash"),
                          F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    shares = shares.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__taken")))
    part = F.col("__taken") % F.col("__size")
    copies = F.concat(F.array_repeat("__size", F.floor(F.col("__taken") / F.col("__size")).cast("int")),
                      F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    taken = rows.join(shares.filter("__taken > 0"), [*keys, "__n"]).withColumn("__words", F.explode(copies))
    whole = F.col("__words") == F.col("__size")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1),
                               F.col("__words").cast("int")), " ")
    return taken.withColumn(text_column, F.when(whole, F.col(text_column)).otherwise(cut)).withColumn(
        length_column, F.when(whole, F.col(length_column)).otherwise(F.length(text_column))).select(
        *map(exact, columns))
