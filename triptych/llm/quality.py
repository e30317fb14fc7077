"""A quality classifier on supervised subword embeddings."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.functions.text import exact
from triptych.llm.common import slices, whole_text

# N-gram lengths, and how many vectors words and n-grams have, each.
LENGTHS = (3, 4, 5)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
REPEAT = 2 * BUCKETS
FEATURES = 2 * BUCKETS + 1
# Characters whose features are found at a time.
BLOCK = 1 << 19
GAP = re.compile(r"[\x20\x09-\x0D]")
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(64, 0xC2B2AE3D27D4EB4F, np.uint64), dtype=np.uint64)


def _bucket(value: np.ndarray, offset: int) -> np.ndarray:
    mixed = (value ^ value >> np.uint64(29)) * MIX
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) + np.int32(offset)


def _pieces(texts: Sequence[str]) -> Iterator[tuple[list[str], list[int]]]:
    """The texts in runs of about BLOCK characters; a longer text is cut at white space, where no feature is cut."""
    some: list[str] = []
    owners: list[int] = []
    size = 0
    for owner, text in enumerate(texts):
        start = 0
        while True:
            gap = GAP.search(text, start + BLOCK) if len(text) > start + BLOCK else None
            end = gap.start() if gap else len(text)
            some.append(text[start:end])
            owners.append(owner)
            size += end - start
            start = end
            if size >= BLOCK:
                yield some, owners
                some, owners, size = [], [], 0
            if start >= len(text):
                break
    if some:
        yield some, owners


def features(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of features: their buckets, and for the texts that have them their numbers and the runs' bounds.

    Features are the words and their n-grams, with a blank for each end of a word. Pairs of
    words have one feature, for a word that is the same as the one before it.
    """
    for some, owners in _pieces(texts):
        codes = np.frombuffer((" " + " ".join(some) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
        blank = (codes == 32) | (codes >= 9) & (codes <= 13)
        codes[blank] = 32
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        bounds = np.r_[0, np.cumsum(lengths + 1)]
        owner = np.array(owners)
        starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        if not len(starts):
            continue
        place = np.arange(len(codes) - starts[0]) - np.repeat(starts - starts[0], np.diff(np.r_[starts, len(codes)]))
        letters = np.where(blank, np.uint64(0), codes)[starts[0]:]
        words = np.add.reduceat(letters * POWERS[np.minimum(place, 63)], starts - starts[0])
        yield _bucket(words, 0), owner, np.searchsorted(starts, bounds)
        same = np.r_[False, words[1:] == words[:-1]]
        first = np.searchsorted(starts, bounds[:-1])
        same[first[first < len(starts)]] = False
        again = starts[same]
        yield np.full(len(again), REPEAT, np.int32), owner, np.searchsorted(again, bounds)
        for n in LENGTHS:
            last = len(codes) - n + 1
            if last <= 0:
                break
            inner = blank[1:last + 1].copy()
            for i in range(2, n - 1):
                inner |= blank[i:last + i]
            at = np.flatnonzero(~inner)
            value = codes[at] * POWERS[0]
            for i in range(1, n):
                value += codes[at + i] * POWERS[i]
            # An n-gram that begins with the blank before a text belongs to that text.
            yield _bucket(value + np.uint64(n), BUCKETS), owner, np.searchsorted(at, bounds)


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text, and how often it has each."""
    total = np.zeros(FEATURES, np.int64)
    for buckets, _, _ in features([text]):
        total += np.bincount(buckets, minlength=FEATURES)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


@dataclass
class QualityModel:
    """Vectors of the features and, for each class, what the average is multiplied with."""

    vectors: np.ndarray
    output: np.ndarray
    prior: np.ndarray

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """The probability of class 1: softmax over the average of the features' vectors.

        With two classes the softmax needs the difference of the classes alone, and a product
        with the average is the average of products. So each vector is multiplied first.
        """
        logits = self.vectors @ (self.output[1] - self.output[0])
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, owner, bounds in features(texts):
            sums = np.r_[0.0, np.cumsum(logits[buckets], dtype=np.float64)]
            np.add.at(total, owner, sums[bounds[1:]] - sums[bounds[:-1]])
            np.add.at(n, owner, np.diff(bounds))
        margin = total / np.maximum(n, 1) + self.prior[1] - self.prior[0]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(samples: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], dim: int = 16,
        epochs: int = 5, rate: float = 0.5, seed: int = 42) -> QualityModel:
    """Stochastic gradient descent on the cross-entropy, one text after the other, in a new order each epoch."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (FEATURES, dim)).astype(np.float32)
    output = rng.uniform(-1 / dim, 1 / dim, (2, dim)).astype(np.float32)
    prior = np.zeros(2, np.float32)
    step, steps = 0, epochs * len(samples)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            speed = rate * (1 - step / steps)
            step += 1
            found, counts = samples[i]
            share = counts / max(counts.sum(), 1)
            mean = share @ vectors[found] if len(found) else np.zeros(dim, np.float32)
            margin = output @ mean + prior
            error = np.exp(margin - margin.max())
            error /= error.sum()
            error[labels[i]] -= 1
            back = error @ output
            output -= speed * np.outer(error, mean).astype(np.float32)
            prior -= 0.1 * speed * error.astype(np.float32)
            if len(found):  # the average moves by the step, however many features share it
                vectors[found] -= (speed / (share @ share) * share[:, None] * back[None, :]).astype(np.float32)
    return QualityModel(vectors, output, prior)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [feature_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([a.tobytes() for a, _ in pairs], pa.binary()),
             pa.array([b.tobytes() for _, b in pairs], pa.binary())], ["label", "found", "counts"])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", sample_rows: int = 3000, seed: int = 42) -> QualityModel | None:
    """A model of the rows of `docs` that `labels` gives 0 or 1; None if there are none.

    It is fitted on at most `sample_rows` rows, the first by a hash of their id, and of their
    text where an id has several; the driver gets their feature counts (at most 512 KB each,
    usually some KB). Rows of one id, text and label count once. Other labels, NULL ids and
    ids without a document are left out.
    """
    chosen = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).distinct().orderBy(
        F.xxhash64(F.lit(seed), "id"), "id", "label").limit(sample_rows)
    rows = docs.select(whole_text(text_column).alias("text"), F.col(id_column).alias("key")).join(
        F.broadcast(chosen), F.col("key") == F.col("id"))  # at most `sample_rows` ids
    rows = rows.groupBy("key", "label", F.xxhash64("text").alias("print")).agg(F.min("text").alias("text")).orderBy(
        F.xxhash64(F.lit(seed), "key"), "key", "label", "print").limit(sample_rows)
    found = rows.select("text", "label", "key").mapInArrow(
        _counting, "label int, found binary, counts binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["label", "found", "counts"], kind="stable")
    samples = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(
        found["found"], found["counts"], strict=True)]
    return fit(samples, found["label"].tolist(), seed=seed)


def score(docs: DataFrame, model: QualityModel | None, text_column: str = "text",
          carry: Sequence[str] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns `carry` of each row of `docs`, with `score` (0 to 1) and `predicted`.

    The score is made from the whole text alone and is the higher the likelier label 1 is;
    `predicted` is 1 from `threshold` on. NULL and blank texts have no features and get the
    score of the prior; without a model all texts get 0.5. Repeated rows are each given.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    rows = docs.select(whole_text(text_column).alias("text"), *(exact(c).alias(f"c{i}") for i, c in enumerate(carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                scores = model.scores(texts) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores)],
                                                 [*part.schema.names[1:], "score"])

    out = rows.mapInArrow(run, ", ".join([*(f"c{i} {kind}" for i, kind in enumerate(kinds)), "score double"]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
