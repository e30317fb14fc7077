"""Row cleaning, trial limits and review samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from triptych.functions.text import exact, strip
from triptych.operators.ordinal import with_input_ordinal, with_ordinal
from triptych.sources.readers import (
    BASE_COLUMNS,
    BLOCK_COLUMN,
    FILE_COLUMN,
    ID_COLUMN,
    INPUT_ORDER,
    whole_number,
)

_SAMPLE_RANGE = 10007
_SAMPLE_STEP = 7919


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of `columns` is NULL."""
    keep = F.lit(True)
    for name in columns:
        keep = keep & exact(name).isNotNull()
    return df.filter(keep)


def clean_base(df: DataFrame, order: Sequence[str | Column] = INPUT_ORDER) -> DataFrame:
    """Usable base idioms: idiom_id, idiom, meaning, german_idiom.

    The idiom is stripped and must not be blank. Ids are whole numbers, also if
    written like `7.0`. Without an id column the id is the row's place among the
    rows kept, in `order`.
    """
    kept = (drop_incomplete(df, BASE_COLUMNS)
            .withColumn("Idiom", strip(F.col("Idiom")))
            .filter(F.col("Idiom") != ""))
    if ID_COLUMN in df.columns:
        kept = kept.withColumn("idiom_id", whole_number(exact(ID_COLUMN)))
    elif tuple(map(str, order)) == INPUT_ORDER:
        kept = with_input_ordinal(kept, FILE_COLUMN, BLOCK_COLUMN, "idiom_id")
    else:
        kept = with_ordinal(kept, order, "idiom_id")
    idiom, meaning, german = (exact(n) for n in BASE_COLUMNS)
    return kept.select("idiom_id", idiom.alias("idiom"), meaning.alias("meaning"),
                       german.alias("german_idiom"))


def first_rows(df: DataFrame, key: str | Sequence[str], n: int) -> DataFrame:
    """The first `n` rows by key, for a trial run."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def _spread(df: DataFrame, key: str) -> Column:
    whole = isinstance(df.schema[key].dataType, IntegralType)
    number = F.col(key) if whole else F.xxhash64(key)
    return F.pmod(F.pmod(number, F.lit(_SAMPLE_RANGE)) * _SAMPLE_STEP, F.lit(_SAMPLE_RANGE))


def review_sample_per_stratum(df: DataFrame, strata: Sequence[str], key: str, k: int) -> DataFrame:
    """Exactly `k` rows of each stratum (all of a smaller one), always the same ones.

    The rows are those of the `k` smallest spreads of the key (as `review_sample` spreads
    it), ties by the key. Each task keeps the bottom k of every stratum before the shuffle
    (Spark's group limit under the rank filter), so a stratum moves at most k rows a task
    whatever its size, and the last bottom k is taken of those. A NULL stratum is one
    stratum; rows with a NULL key come last.
    """
    order = Window.partitionBy(*strata).orderBy(_spread(df, key).asc_nulls_last(), F.col(key).asc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def review_sample(df: DataFrame, key: str, percent: float) -> DataFrame:
    """About `percent` of the rows, always the same ones, for manual review.

    Remainders of a whole-number key are scattered, so that neighbours do not
    go together; any other key is hashed.
    """
    return df.filter(_spread(df, key) < percent * _SAMPLE_RANGE / 100)
