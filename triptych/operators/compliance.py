"""Checks of generated texts against the rules in their prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.text import truthy

# Letters, not marks or stops: of the Arabic script, presentation forms included, and Latin ones.
ARABIC = r"[\p{IsArabic}&&\p{L}]"
LATIN = r"[\p{IsLatin}&&\p{L}]"


def uses_phrase(text: Column, phrase: Column) -> Column:
    """Whether the text has the phrase exactly; False if either is missing."""
    return F.coalesce(truthy(phrase) & F.contains(text, phrase), F.lit(False))


def uses_bold(sentence: Column, idiom: Column) -> Column:
    """Whether the sentence has the idiom in bold."""
    return uses_phrase(sentence, F.concat(F.lit("**"), idiom, F.lit("**")))


def is_native_script(text: Column) -> Column:
    """Written in Perso-Arabic: at least one letter of that script, and no Latin one."""
    return F.coalesce(text.rlike(ARABIC) & ~text.rlike(LATIN), F.lit(False))


def is_roman_script(text: Column) -> Column:
    """Written in Latin: a Latin letter and no Perso-Arabic one."""
    return F.coalesce(text.rlike(LATIN) & ~text.rlike(ARABIC), F.lit(False))


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """The rules that each row breaks: key, rule."""
    broken = F.array(*(F.when(~ok, F.lit(rule)) for rule, ok in rules.items()))
    return (df.select(key, F.explode(F.array_compact(broken)).alias("rule")))


def dataset_rules(dataset_columns: Sequence[str]) -> dict[str, Column]:
    """The prompt rules as columns over the finished table."""
    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    def unless_missing(name: str, ok: Column) -> Column:
        return col(name).isNull() | ok

    native_a, roman_a = "Urdu Native Target A (Idiomatic)", "Urdu Roman Target A (Idiomatic)"
    rules = {
        "sentence has the idiom in bold": uses_bold(col("English Sentence"), col("English Idiom")),
        "German A uses the idiom": uses_phrase(col("German Target A (Figurative)"),
                                               col("German Idiom Match")),
        "native A uses the idiom": unless_missing(
            native_a, uses_phrase(col(native_a), col("Urdu Native Idiom"))),
        "roman A uses the idiom": unless_missing(
            roman_a, uses_phrase(col(roman_a), col("Urdu Roman Idiom"))),
    }
    for script, ok in (("Native", is_native_script), ("Roman", is_roman_script)):
        texts = [c for c in dataset_columns if c.startswith(f"Urdu {script} ")]
        rules[f"{script.lower()} texts are in their script"] = reduce(
            lambda a, b: a & b, (unless_missing(c, ok(col(c))) for c in texts), F.lit(True))
    return rules
