"""Reviewed choices over generated idioms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.prompts import TRANSLITERATION_TEMPLATE, transliteration_prompt
from triptych.functions.text import truthy
from triptych.operators.attempts import MAX_ATTEMPTS
from triptych.operators.stages import TRANSLITERATION, Generator, StageResult, run_stage


def one_per_key(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key; two rows of a key that differ stop the job."""
    row = F.struct(*columns)
    merged = df.groupBy(key).agg(F.min(row).alias("_least"), F.max(row).alias("_most"))
    agreed = F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_least")).otherwise(
        F.raise_error(F.concat(F.lit(f"different rows for {key} "), F.col(key).cast("string"))))
    return merged.select(key, agreed.alias("_row")).select(key, "_row.*")


def override(generated: DataFrame, curated: DataFrame, columns: Mapping[str, str],
             key: str = "idiom_id") -> DataFrame:
    """Generated columns replaced by reviewed ones where a review exists.

    `columns` maps each generated column to its reviewed one. The reviewed
    table is joined on the key; Spark broadcasts it if it is small.
    """
    reviewed = one_per_key(curated, key, sorted(set(columns.values())))
    reviewed = reviewed.select(key, *(F.col(c).alias(f"_reviewed_{c}")
                                      for c in sorted(set(columns.values()))))
    picked = [F.coalesce(f"_reviewed_{columns[c]}", c).alias(c) if c in columns else F.col(f"`{c}`")
              for c in generated.columns]
    return generated.join(reviewed, key, "left").select(*picked)


def pool_candidates(pools: Mapping[str, DataFrame], key: str = "idiom_id") -> DataFrame:
    """The candidates of several generators as rows: key, generator, candidate."""
    frames = [df.select(key, F.lit(name).alias("generator"), "candidate")
              for name, df in pools.items()]
    return reduce(DataFrame.unionByName, frames)


def choose_candidates(pool: DataFrame, choices: DataFrame, priority: Sequence[str],
                      key: str = "idiom_id") -> DataFrame:
    """One candidate per key: key, generator, candidate, reviewed.

    `choices` (key, generator) holds the reviewer's picks. Without a pick, or
    if the picked generator has no candidate, the first generator of
    `priority` that has one is taken; blank candidates do not count. All
    generators must be in `priority`.

    The pool is brought down to one row per key before it meets the picks, so
    a key with very many candidates never sits in one join task.
    """
    usable = pool.filter(truthy(F.col("candidate")))
    best = usable.groupBy(key).agg(
        F.max(F.when(~F.col("generator").isin(*priority), F.col("generator"))).alias("_stray"),
        *(F.min(F.when(F.col("generator") == name, F.col("candidate"))).alias(f"_from_{i}")
          for i, name in enumerate(priority)))
    picks = one_per_key(choices, key, ["generator"]).withColumnRenamed("generator", "_picked")

    def option(i: int, reviewed: bool) -> Column:
        there = F.col(f"_from_{i}").isNotNull()
        if reviewed:
            there = there & (F.col("_picked") == priority[i])
        return F.when(there, F.struct(F.lit(priority[i]).alias("generator"),
                                      F.col(f"_from_{i}").alias("candidate"),
                                      F.lit(reviewed).alias("reviewed")))

    places = range(len(priority))
    chosen = F.when(F.col("_stray").isNull(), F.coalesce(
        *(option(i, True) for i in places), *(option(i, False) for i in places))).otherwise(
        F.raise_error(F.concat(F.lit("no priority for generator "), "_stray")))
    return (best.join(picks, key, "left").select(key, chosen.alias("_option"))
            .select(key, "_option.*"))


def transliterate(curated: DataFrame, generator: Generator, store: str,
                  template: str = TRANSLITERATION_TEMPLATE,
                  max_attempts: int = MAX_ATTEMPTS) -> StageResult:
    """Native-script forms of reviewed roman idioms (idiom_id, urdu_roman)."""
    prompts = curated.select(F.col("idiom_id").cast("long"),
                             transliteration_prompt(F.col("urdu_roman"), template).alias("prompt"))
    return run_stage(TRANSLITERATION, prompts, generator, store, max_attempts)
