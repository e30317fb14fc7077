"""What is known about each target language: headers, codes, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.functions.text import exact
from triptych.operators.headers import resolve_roles
from triptych.operators.triples import TEXTS, drop_incomplete_triples, project_triples
from triptych.sources.readers import read_table

Labels = Mapping[str, str]


@dataclass(frozen=True)
class Profile:
    """A target language. `code` and `pair_code` are what the two families of
    scorers call it; `labels` name the candidates in reports."""

    language: str
    folder: str
    headers: Mapping[str, tuple[str, ...]]
    code: str
    pair_code: str
    labels: Labels
    corrected_labels: Labels
    source_code: str = "en"


# Header names, codes and labels per language. The last header of
# each Urdu candidate is the one `wide_dataset` writes.
PROFILES: dict[str, Profile] = {
    "de": Profile(
        "de", "german",
        {"src": ("English Sentence",),
         "cand_a": ("Target A (Figurative)", "Target A"),
         "cand_b": ("Target B (Alternative)", "Target B"),
         "cand_c": ("Target C (Literal Incorrect)", "Target C")},
        "de", "de",
        {"A": "Figurative", "B": "Literal", "C": "Incorrect"},
        {"A": "Figurative", "B": "Alternative", "C": "Literal Incorrect"}),
    "ur-native": Profile(
        "ur-native", "urdu_native",
        {"src": ("English Sentence",),
         "cand_a": ("Native Idiomatic", "Target A (Native Idiomatic)",
                    "Urdu Native Target A (Idiomatic)"),
         "cand_b": ("Native Descriptive", "Target B (Native Descriptive)",
                    "Urdu Native Target B (Descriptive)"),
         "cand_c": ("Native Literal", "Target C (Native Literal)",
                    "Urdu Native Target C (Literal)")},
        "ur", "ur",
        {"A": "Native Idiomatic", "B": "Native Descriptive", "C": "Native Literal"},
        {"A": "Native Idiomatic", "B": "Native Descriptive", "C": "Native Literal"}),
    "ur-roman": Profile(
        "ur-roman", "urdu_roman",
        {"src": ("English Sentence",),
         "cand_a": ("Roman Idiomatic", "Target A (Roman Idiomatic)",
                    "Urdu Roman Target A (Idiomatic)"),
         "cand_b": ("Roman Descriptive", "Target B (Roman Descriptive)",
                    "Urdu Roman Target B (Descriptive)"),
         "cand_c": ("Roman Literal", "Target C (Roman Literal)",
                    "Urdu Roman Target C (Literal)")},
        "ur_roman", "ur_rom",
        {"A": "Roman Idiomatic", "B": "Roman Descriptive", "C": "Roman Literal"},
        {"A": "Roman Idiomatic", "B": "Roman Descriptive", "C": "Roman Literal"}),
}


def load_triples(spark: SparkSession, path: str, language: str, key: str | None = None,
                 multiline: bool = True) -> DataFrame:
    """Complete triples of one language out of a delimited table."""
    table = read_table(spark, path, multiline, input_order=key is None)
    roles = resolve_roles(table.columns, PROFILES[language].headers)
    return project_triples(table, roles, key)


def load_languages(spark: SparkSession, path: str, languages: Sequence[str], key: str,
                   multiline: bool = True) -> DataFrame:
    """Complete triples of several languages that share a table, read once.

    Gives language, seg_id (from `key`) and the texts.
    """
    table = read_table(spark, path, multiline)
    per_language = []
    for language in languages:
        roles = resolve_roles(table.columns, PROFILES[language].headers)
        per_language.append(F.struct(F.lit(language).alias("language"),
                                     *(exact(roles[r]).alias(r) for r in TEXTS)))
    rows = table.select(exact(key).cast("long").alias("seg_id"),
                        F.explode(F.array(*per_language)).alias("_row"))
    return drop_incomplete_triples(rows.select("_row.language", "seg_id",
                                               *(f"_row.{r}" for r in TEXTS)))


def union_languages(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Frames of several languages as one, with a `language` column."""
    named = [df.select(F.lit(language).alias("language"), "*") for language, df in frames.items()]
    return reduce(DataFrame.unionByName, named)
