"""Language identification by string kernels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triptych.functions.text import exact
from triptych.llm.common import slices, whole_text

LONGEST = 3  # n-grams have 1 to so many characters
SPACE_BITS = 20  # n-grams are told apart by so many bits of a hash
BLOCK = 1 << 17  # characters of a text whose n-grams are found at a time
ROWS = 128  # texts of one matrix product
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")  # a letter of any script; not digits, fractions or numerals
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Spectrum:
    """The distinct n-grams of texts, as places in a table of hashes."""

    def __init__(self):
        self.last = np.zeros(1 << SPACE_BITS, np.int32)

    def _distinct(self, places: np.ndarray) -> np.ndarray:
        order = np.arange(len(places), dtype=np.int32)
        self.last[places] = order
        return places[self.last[places] == order]

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        found = []
        for start in range(0, len(codes), BLOCK):
            some = codes[start:start + BLOCK + LONGEST - 1].astype(np.uint64)
            value = np.zeros(len(some), np.uint64)
            for n in range(1, LONGEST + 1):
                if len(some) < n:
                    break
                value = value[:len(some) - n + 1] + (some[n - 1:] + np.uint64(n)) * MULTIPLIERS[n - 1]
                mixed = (value ^ value >> np.uint64(32)) * MULTIPLIERS[1]
                found.append(self._distinct((mixed >> np.uint64(64 - SPACE_BITS)).astype(np.int32)))
        return self._distinct(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class LanguageModel:
    """Landmark texts as sets of n-grams, and the weight of each for each language."""

    languages: list[str]
    columns: np.ndarray  # n-grams that a landmark has, sorted
    landmarks: np.ndarray  # 0 or 1, landmarks by columns
    weights: np.ndarray  # landmarks by languages
    bias: np.ndarray

    def predict(self, texts: Sequence[str], spectrum: Spectrum) -> tuple[list[str], list[float]]:
        """Languages and scores; `und` and 0 for a text without a letter."""
        known = np.full(1 << SPACE_BITS, -1, np.int32)
        known[self.columns] = np.arange(len(self.columns))
        right = (self.landmarks / np.sqrt(self.landmarks.sum(axis=1, keepdims=True))).T.astype(np.float32)
        names, scores = [], []
        for start in range(0, len(texts), ROWS):
            some = texts[start:start + ROWS]
            lettered = [bool(LETTER.search(t)) for t in some]
            kernel = _kernel([spectrum.of(t) if ok else np.zeros(0, np.int32) for t, ok in zip(
                some, lettered, strict=True)], known, right)
            margins = kernel @ self.weights + self.bias
            best = margins.argmax(axis=1)
            share = np.clip((margins[np.arange(len(some)), best] + 1) / 2, 0, 1)
            names += [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
            scores += [float(s) if ok else 0.0 for s, ok in zip(share, lettered, strict=True)]
        return names, scores


def _kernel(spectra: list[np.ndarray], known: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared n-grams over the root of both texts' numbers of n-grams, texts by landmarks: one matrix product."""
    left = np.zeros((len(spectra), len(right)), np.float32)
    for row, places in enumerate(spectra):
        at = known[places]
        left[row, at[at >= 0]] = 1
    norms = np.sqrt(np.maximum([len(s) for s in spectra], 1)).astype(np.float32)
    return left @ right / norms[:, None]


def fit(languages: Sequence[str], spectra: Sequence[np.ndarray], landmarks: int, ridge: float = 1e-2) -> LanguageModel:
    """Kernel ridge regression of one language against the rest, on Nyström features.

    `landmarks` of each language's texts, the first ones, are landmarks.
    """
    names = sorted(set(languages))
    chosen = [i for name in names for i in [j for j, x in enumerate(languages) if x == name][:landmarks]]
    columns = np.unique(np.concatenate([spectra[i] for i in chosen]))
    known = np.full(1 << SPACE_BITS, -1, np.int32)
    known[columns] = np.arange(len(columns))
    marks = np.zeros((len(chosen), len(columns)), np.uint8)
    for row, i in enumerate(chosen):
        marks[row, known[spectra[i]]] = 1
    right = (marks / np.sqrt(marks.sum(axis=1, keepdims=True))).T.astype(np.float32)
    rows = [_kernel(list(spectra[i:i + ROWS]), known, right) for i in range(0, len(spectra), ROWS)]
    kernel = np.concatenate(rows).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    features = vectors[:, good] / np.sqrt(values[good])
    x = np.c_[kernel @ features, np.ones(len(kernel))]
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    return LanguageModel(names, columns, marks, features @ solved[:-1], solved[-1])


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spectrum = Spectrum()
    for batch in batches:
        for part in slices(batch, "text"):
            grams = [spectrum.of(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("spot"), pa.array(grams, pa.binary())],
                                             ["lang", "spot", "grams"])


def train(docs: DataFrame, text_column: str = "text", language_column: str = "lang",
          per_language: int = 256, landmarks: int = 32, seed: int = 42) -> LanguageModel | None:
    """A model of the labelled rows of `docs`; None if there are none.

    It is fitted on at most `per_language` distinct texts of each language, chosen by a hash
    of the text, so that copies count once; the driver gets their sets of n-grams (at most 4 MB each, usually some KB). Rows
    without text, letter or language are left out. The languages must be few enough to be
    listed.
    """
    rows = docs.select(whole_text(text_column).alias("text"), F.col(language_column).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn(
        "spot", F.xxhash64(F.lit(seed), "text"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "spot").distinct().groupBy("lang").agg(
        F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # Enough for `per_language`, and few enough to be put in order.
    rate = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (
        name, min(1.0, (2 * per_language + 50) / n))))
    fraction = F.pmod("spot", F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(fraction < F.get(F.map_values(F.map_filter(rate, lambda k, v: k == F.col("lang"))), F.lit(0)))
    some = some.groupBy("lang", "spot").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(fraction, "spot")
    some = some.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
    sample = some.select("text", "lang", "spot").mapInArrow(_spectra, "lang string, spot long, grams binary").toPandas()
    sample = sample.sort_values(["lang", "spot"], kind="stable")
    return fit(sample["lang"].tolist(), [np.frombuffer(g, np.int32) for g in sample["grams"]], landmarks)


def _identified(docs: DataFrame, model: LanguageModel | None, text_column: str, carry: Sequence[str]) -> DataFrame:
    """The columns `carry` as c0, c1 and so on, with `lang_pred` and `score`."""
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    rows = docs.select(whole_text(text_column).alias("text"), *(exact(c).alias(f"c{i}") for i, c in enumerate(carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                names, scores = model.predict(texts, spectrum) if model else (
                    [UNDETERMINED] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*part.schema.names[1:], "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join(
        [*(f"c{i} {kind}" for i, kind in enumerate(kinds)), "lang_pred string, score double"]))


def identify(docs: DataFrame, model: LanguageModel | None, text_column: str = "text",
             carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of each row of `docs`, with `lang_pred` and `score`.

    The prediction is made from the whole text alone: of its distinct n-grams, those that
    each landmark has too, over the root of both numbers of n-grams, weighted per language;
    the best language's margin, -1 to 1, makes a score of 0 to 1. Texts without a letter
    (NULL and empty ones) are `und` with score 0, as are all texts without a model. Repeated
    rows are each given. Columns of `docs` may have any names.
    """
    found = _identified(docs, model, text_column, carry)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_column: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a letter (`\\p{L}`), with all their columns.

    With a model every text with a letter gets a language, so the rows kept are the same
    whether or not any row had a label; without one they are found by Spark alone.
    """
    if model is None:
        return docs.filter(F.coalesce(exact(text_column).rlike(r"\p{L}"), F.lit(False)))
    found = _identified(docs, model, text_column, docs.columns).filter(F.col("lang_pred") != UNDETERMINED)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
