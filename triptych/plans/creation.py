"""The dataset job: base idioms in, finished contrastive table out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.prompts import german_prompt, identification_prompt, urdu_prompt
from triptych.operators.attempts import MAX_ATTEMPTS, cost_summary
from triptych.operators.curation import override
from triptych.operators.stages import (
    GERMAN,
    IDENTIFICATION,
    URDU,
    Generator,
    Stage,
    StageResult,
    has_both_idioms,
    run_stage,
    wide_dataset,
)

CURATED_COLUMNS = {"urdu_idiom_native": "urdu_native", "urdu_idiom_roman": "urdu_roman"}


@dataclass(frozen=True)
class DatasetRun:
    """`rejected` has stage and idiom_id of prompts that got no usable reply."""

    dataset: DataFrame
    attempts: DataFrame
    costs: DataFrame
    rejected: DataFrame


def create_dataset(base: DataFrame, generators: Generator | Mapping[str, Generator], store: str,
                   curated: DataFrame | None = None, max_attempts: int = MAX_ATTEMPTS,
                   resume: bool = False) -> DatasetRun:
    """Run the three stages over `base` (idiom_id, idiom, meaning, german_idiom).

    A later stage is asked only for rows that passed the earlier ones; a row
    without Urdu idioms goes on with NULL. `generators` is one model for all
    stages or one per stage name. Reviewed Urdu idioms of `curated` replace the
    generated ones before translation.

    Rows travel with their prompts through the stages, so the stages need no
    joins with one another.
    """
    def run(stage: Stage, rows: DataFrame, prompt: Column) -> StageResult:
        generator = generators[stage.name] if isinstance(generators, Mapping) else generators
        return run_stage(stage, rows.withColumn("prompt", prompt), generator, store,
                         max_attempts, resume)

    idiom, meaning, sentence = F.col("idiom"), F.col("meaning"), F.col("english_sentence")
    german = run(GERMAN, base, german_prompt(idiom, meaning, F.col("german_idiom")))
    found = run(IDENTIFICATION, german.replies, identification_prompt(idiom, meaning, sentence))
    rows = found.settled
    if curated is not None:
        rows = override(rows, curated, CURATED_COLUMNS)
    urdu = run(URDU, rows.filter(has_both_idioms()),
               urdu_prompt(sentence, idiom, meaning, F.col("urdu_idiom_native"),
                           F.col("urdu_idiom_roman")))
    finished = urdu.settled.unionByName(rows.filter(~has_both_idioms()), allowMissingColumns=True)

    results = {GERMAN.name: german, IDENTIFICATION.name: found, URDU.name: urdu}
    attempts = reduce(DataFrame.unionByName, (r.attempts.drop("kept") for r in results.values()))
    rejected = reduce(DataFrame.unionByName, (
        r.rejected.select(F.lit(name).alias("stage"), "idiom_id") for name, r in results.items()))
    return DatasetRun(wide_dataset(finished), attempts, cost_summary(attempts), rejected)
