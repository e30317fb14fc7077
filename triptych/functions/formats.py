"""Display texts for numbers, and language pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(number: Column, digits: int) -> Column:
    """`digits` decimals, rounded from the exact binary value, ties to even."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.when(F.isnan(number), F.lit("nan")).otherwise(
        F.call_function("format_number", number, F.lit(pattern)))


def mean_text(mean: Column) -> Column:
    return fixed(mean, 2)


def rate_text(rate: Column) -> Column:
    return F.concat(fixed(rate * 100, 2), F.lit("%"))


def cost_text(cost: Column) -> Column:
    return F.concat(F.lit("$"), fixed(cost, 4))


def language_pair(target_code: str | Column, source_code: str = "en") -> Column:
    target = F.lit(target_code) if isinstance(target_code, str) else target_code
    return F.concat(F.lit(f"{source_code}-"), target)
