"""Prompt texts as columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

GERMAN_TEMPLATE = """You are helping to build a test set for English to German idiom translation.

Idiom: **{idiom}**
What it means: {meaning}
German counterpart: "{german_idiom}"

Write one natural English sentence with the idiom in bold. Then give that sentence in German three times:
A - idiomatic, with the German counterpart exactly as given
B - correct, saying what is meant without any idiom
C - wrong, the idiom carried over word by word

Answer with a single JSON object and nothing else. Its keys:
english_sentence, target_A, target_B, target_C"""

IDENTIFICATION_TEMPLATE = """You know the idioms of both English and Urdu well.

English idiom: "{idiom}"
What it means: "{meaning}"
Used in: "{sentence}"

Which Urdu idiom or proverb comes closest to this figurative meaning?

Answer with a single JSON object and nothing else. Its keys:
urdu_idiom_native (in Perso-Arabic script), urdu_idiom_roman (in Latin script)"""

URDU_TEMPLATE = """You are helping to build a test set for English to Urdu idiom translation.

English sentence: "{sentence}"
English idiom: "{idiom}"
What it means: "{meaning}"
Urdu idiom in Perso-Arabic script: "{urdu_native}"
Urdu idiom in Latin script: "{urdu_roman}"

Translate the sentence six times, three times in each script.
A - idiomatic, with the Urdu idiom of that script exactly as given
B - correct, saying what is meant without the idiom
C - wrong, the English idiom carried over word by word
Each Latin version is the same sentence as the Perso-Arabic one of its letter.

Answer with a single JSON object and nothing else. Its keys:
target_A_native, target_B_native, target_C_native, target_A_roman, target_B_roman, target_C_roman"""

TRANSLITERATION_TEMPLATE = """Write this Urdu idiom, given in Latin script, in Perso-Arabic script: "{urdu_roman}"

Answer with a single JSON object and nothing else. Its key:
urdu_idiom_native"""


def render(template: str, **values: Column) -> Column:
    """`template` with each `{name}` replaced by its column, NULL as empty text."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def german_prompt(idiom: Column, meaning: Column, german_idiom: Column,
                  template: str = GERMAN_TEMPLATE) -> Column:
    return render(template, idiom=idiom, meaning=meaning, german_idiom=german_idiom)


def identification_prompt(idiom: Column, meaning: Column, sentence: Column,
                          template: str = IDENTIFICATION_TEMPLATE) -> Column:
    return render(template, idiom=idiom, meaning=meaning, sentence=sentence)


def urdu_prompt(sentence: Column, idiom: Column, meaning: Column, urdu_native: Column,
                urdu_roman: Column, template: str = URDU_TEMPLATE) -> Column:
    return render(template, sentence=sentence, idiom=idiom, meaning=meaning,
                  urdu_native=urdu_native, urdu_roman=urdu_roman)


def transliteration_prompt(urdu_roman: Column, template: str = TRANSLITERATION_TEMPLATE) -> Column:
    return render(template, urdu_roman=urdu_roman)
