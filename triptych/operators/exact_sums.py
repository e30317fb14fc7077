"""Means that do not depend on the partitioning: exact sums binned by exponent.

A finite double is m * 2^(e - 52) with a whole m below 2^53 and e its binary exponent
(-1022 for subnormal numbers). Spark sums the m of each (group, e) as decimals, which is
exact and combines before the shuffle whatever the order of the rows; a group then has at
most 2,098 bins, which one Python call adds as a fraction and divides by the count,
rounding once. So a report is the same to the last bit for 1, 7 or 200 partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANTISSA_BITS = 52
LOWEST_EXPONENT = -1022


def exponent(x: Column) -> Column:
    """The binary exponent of a finite non-zero double (LOWEST_EXPONENT for subnormals)."""
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("int")
    fixed = (F.when(F.pow(F.lit(2.0), guess) > size, guess - 1)
             .when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess))
    return F.greatest(fixed, F.lit(LOWEST_EXPONENT))


def _combine(frame: pd.DataFrame) -> pd.DataFrame:
    keys = frame.iloc[0]
    total = Fraction(0)
    for e, m in zip(frame["e"], frame["m"], strict=True):
        if pd.notna(e):
            total += Fraction(int(m)) * Fraction(2) ** (int(e) - MANTISSA_BITS)
    n, nan, up, down = (int(keys[c]) for c in ("n", "nan", "up", "down"))
    # Arrow takes a NaN of pandas for NULL, so the special values are named, and made in Spark.
    special, mean = None, None
    if nan or (up and down):
        special = "NaN"
    elif up or down:
        special = "Infinity" if up else "-Infinity"
    elif n:
        mean = float(total / n)
    return pd.DataFrame({**{c: [keys[c]] for c in frame.columns if c not in ("e", "m", "n", "nan", "up", "down")},
                         "special": [special], "mean": [mean]})


def exact_means(frame: DataFrame, columns: Sequence[str], by: Sequence[str] = (), nan: str = "propagate",
                name: str = "task") -> DataFrame:
    """Per group of `by` and column: by, `name` (the column), average (double).

    The mean of the non-NULL values, exactly rounded from the exact sum. `nan="propagate"`:
    a NaN makes the mean NaN; `"skip"`: NaN is left out. +inf gives inf, -inf -inf, both
    NaN. No value: NULL. Equal for any partitioning and order of the rows.
    """
    if nan not in ("propagate", "skip"):
        raise ValueError(f"nan is 'propagate' or 'skip', not {nan!r}")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("x"))
                                 for c in columns)))
    rows = frame.select(*by, values.alias("v")).select(*by, "v.*")
    x = F.col("x")
    taken = x.isNotNull() & ~F.isnan(x) if nan == "skip" else x.isNotNull()
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & (x != 0)
    keys = [*by, name]
    flags = rows.groupBy(*keys).agg(
        F.count_if(taken).alias("n"), F.count_if(taken & F.isnan(x)).alias("nan"),
        F.count_if(x == float("inf")).alias("up"), F.count_if(x == float("-inf")).alias("down"))
    bins = rows.filter(finite).withColumn("e", exponent(x)).groupBy(*keys, "e").agg(
        F.sum((x / F.pow(F.lit(2.0), F.col("e") - MANTISSA_BITS)).cast("long").cast("decimal(38,0)")).alias("m"))
    # Keys may be NULL: joined NULL-safe.
    bins = bins.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "e", "m")
    joined = flags.join(bins, [flags[k].eqNullSafe(bins[f"_{i}"]) for i, k in enumerate(keys)], "left").drop(
        *(f"_{i}" for i in range(len(keys))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flags.select(*keys).schema.fields)
    means = joined.groupBy(*keys).applyInPandas(_combine, f"{fields}, special string, mean double")
    return means.select(*keys, F.coalesce(F.col("special").cast("double"), "mean").alias("average"))
