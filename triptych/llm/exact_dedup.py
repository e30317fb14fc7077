"""Exact duplicates by polynomial fingerprints, verified chunk by chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.llm.common import BLANK, one_row_each, whole_text
from triptych.sources.shared import materialize

CHUNK_BYTES = 1 << 16

# Two primes below 2^31, so that products of residues fit 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
# A pair of bases for each round; only texts that clash need more than the first.
BASES = ((1_103_515_245, 740_213_771), (392_874_611, 1_618_033_989), (271_828_183, 1_414_213_562),
         (1_732_050_807, 977_613_281), (577_215_664, 693_147_180))


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime, by doubling."""
    out = np.ones(n, np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * pow(base, done, prime) % prime
        done += more
    return out


class Polynomial:
    """Bytes as the digits of a number in `base`, modulo `prime`; (length, value) pairs can be combined."""

    def __init__(self, base: int, prime: int, chunk_bytes: int):
        self.base, self.prime, self.size = base, prime, chunk_bytes
        # A chunk has less than 2^23 bytes: sums of byte times residue fit 64 bits.
        self.falling = powers(base, prime, chunk_bytes)[::-1].copy()

    def chunk_values(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(length, value) of each chunk, each for itself."""
        full = len(data) // self.size
        values = data[:full * self.size].reshape(full, self.size).astype(np.int64) @ self.falling % self.prime
        out = [(self.size, int(v)) for v in values]
        if rest := len(data) - full * self.size:
            out.append((rest, int(data[full * self.size:].astype(np.int64) @ self.falling[-rest:] % self.prime)))
        return out

    def combine(self, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
        """Of two neighbouring texts, the pair of the whole: the left value is shifted by the right length."""
        return (left[0] + right[0],
                (left[1] * pow(self.base, right[0], self.prime) + right[1]) % self.prime)

    def value(self, data: np.ndarray) -> tuple[int, int]:
        whole = (0, 0)
        for chunk in self.chunk_values(data):
            whole = self.combine(whole, chunk)
        return whole


def _printing(bases: tuple[int, int], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [Polynomial(base, prime, size) for base, prime in zip(bases, PRIMES, strict=True)]
        for batch in batches:
            prints = []
            for text in batch.column("text"):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                prints.append(":".join(f"{side.value(data)[1]:x}" for side in sides) + f":{len(data):x}")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints, pa.string())],
                                             [*batch.schema.names[1:], "found"])
    return run


def fingerprints(texts: DataFrame, bases: tuple[int, int] = BASES[0], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`texts` with the fingerprint of `text`, its first column, as `found` in its place.

    The text is cut into chunks which are hashed side by side; their hashes are combined by
    arithmetic, so the result does not depend on where the cuts are.
    """
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[1:]]
    return texts.mapInArrow(_printing(bases, chunk_bytes), ", ".join([*rest, "found string"]))


def _cutting(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, print_ in zip(batch.column("text"), batch.column("print").to_pylist(), strict=True):
                data = text.as_buffer()
                places = range(max(1, -(-len(data) // size)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([print_] * len(places)), pa.array(places, pa.int64()),
                     pa.array([data[p * size:(p + 1) * size].to_pybytes() for p in places], pa.binary())],
                    ["print", "place", "chunk"])
    return run


def _clashing(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """The prints with rows that differ somewhere.

    The least and the greatest chunk at each place are found before the shuffle, so a large
    group of copies sends one pair of chunks from each task.
    """
    parts = texts.select("text", "print").mapInArrow(
        _cutting(chunk_bytes), "print string, place long, chunk binary")
    ends = parts.groupBy("print", "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return ends.filter("low <> high").select("print").distinct()


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                chunk_bytes: int = CHUNK_BYTES,
                bases: Sequence[tuple[int, int]] = BASES) -> DataFrame:
    """One row per document: its id, `keep_id`, `group_size`, `kept`, `text_sha256`, `text_hash`.

    Texts are equal when they are identical after every run of `[\\x20\\x09-\\x0D]` has become
    one space. Of equal texts the row with the smallest id stays (NULL after all others; of
    rows with that id, one). NULL counts as the empty text; empty texts are equal. Other
    columns are not carried; `text_hash` (xxhash64 of the text as given) tells apart rows
    with one id.

    Rows with equal fingerprints are compared: their chunks must have one value at each
    place. Should a fingerprint stand for two texts, its rows get a further one, of other
    bases, until no text differs from those it is grouped with; if `bases` do not suffice,
    the job stops. Every step combines before its shuffle, or is a join that Spark can
    split, so large groups of copies are no hot keys.
    """
    raw = whole_text(text_column)
    rows = docs.select(F.regexp_replace(raw, BLANK, " ").alias("text"), F.col(id_column).alias("key"),
                       F.xxhash64(raw).alias("text_hash"))
    same_row = F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h"))
    hashed = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    seen = materialize(fingerprints(hashed, bases[0], chunk_bytes).withColumnRenamed("found", "print").withColumn(
        "row", F.monotonically_increasing_id()), "prints")
    pending = seen.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    for more in [*bases[1:], None]:
        suspects = seen.join(pending, "print").select(
            F.col("key").alias("k"), F.col("text_hash").alias("h"), "print").distinct()
        suspects = rows.join(suspects, same_row)
        clashes = materialize(_clashing(suspects, chunk_bytes), "clashes")
        if clashes.isEmpty():
            break
        if more is None:
            raise ValueError("texts with equal fingerprints differ, and there are no bases left")
        again = suspects.join(clashes, "print").select("text", "k", "h", F.col("print").alias("was")).distinct()
        again = fingerprints(again, more, chunk_bytes)
        seen = materialize(seen.join(again, same_row & (F.col("print") == F.col("was")), "left").select(
            *(c for c in seen.columns if c != "print"), F.concat_ws("/", "print", "found").alias("print")), "prints")
        pending = seen.filter(F.contains("print", F.lit("/"))).groupBy("print").agg(
            F.count("*").alias("n")).filter("n > 1").select("print")
    first = F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("key"), F.col("row").alias("row"))
    groups = seen.groupBy("print").agg(F.count("*").alias("group_size"), F.min(first).alias("first"))
    return seen.join(groups, "print").select(
        F.col("key").alias(id_column), F.col("first.key").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "text_hash")


def keep_first(docs: DataFrame, judged: DataFrame, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay, `judged` being the result of `exact_dedup` on them.

    Of repeated rows (one id, one text) any one is given.
    """
    return one_row_each(docs, judged.filter("kept"), id_column, text_column)
