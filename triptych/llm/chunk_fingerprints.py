"""Document fingerprints of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triptych.llm.common import slices, whole_text

# Bytes that a gear hash of 32 bits depends on, and bytes that are hashed at a time.
REACH = 32
BLOCK = 1 << 20
SLICE_BYTES = 1 << 20


def gear_table(seed: int = 42) -> np.ndarray:
    """A random number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Chunking:
    """Lengths in bytes: a chunk has `least` to `most`, about `usual` on average.

    Before `usual`, a boundary needs `bits` + 1 zero bits of the hash, after it `bits` - 1, so
    that lengths gather around it; 2 to the power of `bits` is about `usual`.
    """

    least: int = 12
    usual: int = 32
    most: int = 128
    bits: int = 5


def boundary_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: hash * 2 + gear[byte], from 0 at the start, in 32 bits."""
    out = np.empty(len(data), np.uint32)
    for start in range(0, len(data), BLOCK):
        before = min(start, REACH)
        value = gear[data[start - before:start + BLOCK]]
        width = 1
        while width < REACH:
            value[width:] += value[:-width] << np.uint32(width) if len(value) > width else 0
            width *= 2
        out[start:start + BLOCK] = value[before:]
    return out


def chunk_ends(data: np.ndarray, gear: np.ndarray, chunking: Chunking) -> list[int]:
    """Where the chunks of one text end."""
    top = boundary_hashes(data, gear) >> np.uint32(32 - chunking.bits - 1)
    easy = np.flatnonzero(top >> np.uint32(2) == 0) + 1
    hard = easy[top[easy - 1] == 0].tolist()
    easy = easy.tolist()
    ends: list[int] = []
    start, n, h, e = 0, len(data), 0, 0
    while n - start > chunking.least:
        low, middle, high = start + chunking.least, start + chunking.usual, min(start + chunking.most, n)
        while h < len(hard) and hard[h] < low:
            h += 1
        if h < len(hard) and hard[h] < min(middle, high):
            start = hard[h]
        else:
            while e < len(easy) and easy[e] < middle:
                e += 1
            start = easy[e] if e < len(easy) and easy[e] < high else high
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def digests(data: bytes, gear: np.ndarray, chunking: Chunking) -> np.ndarray:
    """The set of chunks, sorted: for each 40 bits of its hash, then 16 bits of its length."""
    found, start, digest = [], 0, xxhash.xxh64_intdigest
    view = memoryview(data)
    for end in chunk_ends(np.frombuffer(data, np.uint8), gear, chunking):
        found.append((digest(view[start:end]) & 0xFFFFFFFFFF) << 16 | end - start)
        start = end
    return np.unique(np.array(found, np.uint64))


def containment(one: np.ndarray, other: np.ndarray) -> float:
    """The part of the first text, by length of its distinct chunks, that the second has too."""
    if not len(one):
        return float(not len(other))
    lengths = one & np.uint64(0xFFFF)
    shared = np.isin(one, other, assume_unique=True)
    return float(lengths[shared].sum()) / float(lengths.sum())


def as_text(chunks: np.ndarray) -> str:
    """Fourteen hexadecimal digits a chunk."""
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex(" ", 7)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _comparing(chunking: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        held = None  # the row whose next one is to come: range, id, text, its chunks
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                out: list[list] = [[] for _ in range(7)]
                for bucket, key, text, extra in zip(*(part.column(c).to_pylist() for c in (
                        "bucket", "key", "text", "extra")), strict=True):
                    chunks = digests(text.encode(), gear, chunking)
                    if held is not None and held[0] == bucket:
                        _, own_key, own, own_chunks = held
                        changed = edited(own, text).encode()
                        changed_chunks = digests(changed, gear, chunking)
                        row = (own_key, len(own), hashlib.sha256(changed).hexdigest(), as_text(own_chunks),
                               as_text(changed_chunks), containment(own_chunks, changed_chunks),
                               containment(own_chunks, chunks))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                    held = None if extra else (bucket, key, text, chunks)
                kinds = (batch.schema.field("key").type, pa.int64(), pa.string(), pa.string(), pa.string(),
                         pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)],
                    ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return run


def chunk_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       chunking: Chunking = Chunking(), range_bytes: int = 16 << 20,
                       most_ranges: int = 4000) -> DataFrame:
    """One row per document: id, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`,
    `near_edited` and `near_next`.

    A fingerprint is the set of a text's content-defined chunks, each with its length. The
    edited text is the document with its last half replaced by the beginning of the next
    document in the order of ids (after the last comes the first). `near_edited` and
    `near_next` say what part of the document the edited text and the next document
    contain, from 0 to 1. Equal texts have equal fingerprints.

    Ids are numbers; NULL comes before all others. Rows with one id are in the order of the
    hash of their text, and each counts. NULL texts are empty: an empty document has an
    empty fingerprint, which an empty text alone contains (1, else 0). A single document
    comes after itself. Other columns are not carried.

    Documents are dealt once into ranges of ids, about `range_bytes` of text each, which
    Spark sorts; the first document of each range also goes to the range before, to be the
    next of its last one. A task reads its ranges as a stream and holds one document. At
    most `most_ranges` bounds go through the driver.
    """
    text = whole_text(text_column)
    rows = docs.select(F.col(id_column).alias("key"), text.alias("text"))
    points = [i / most_ranges for i in range(1, most_ranges)]
    size, bounds = rows.agg(F.sum(F.octet_length("text")), F.percentile_approx("key", points, 10 * most_ranges)).first()
    wanted = min(most_ranges, -(-(size or 0) // range_bytes))
    bounds = sorted({bounds[i * len(bounds) // wanted] for i in range(1, wanted)}) if bounds else []
    n = len(bounds) + 1
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("key"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    # One row for each range. The first range comes after the last.
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("key").isNotNull().alias("given"), "key")).alias("first"))
    order = Window.orderBy("bucket")
    firsts = firsts.select(
        F.col("first.key").alias("first"), F.col("bucket").alias("of"),
        F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    own, extra = (F.struct(b.alias("bucket"), F.lit(x).alias("extra")) for b, x in (
        (F.col("bucket"), False), (F.col("before"), True)))
    first = F.col("key").eqNullSafe(F.col("first")) & (F.col("bucket") == F.col("of"))
    places = F.when(F.col("of").isNotNull(), F.array(own, extra)).otherwise(F.array(own))
    dealt = rows.join(F.broadcast(firsts), first, "left").select("key", "text", F.explode(places).alias("place"))
    # Each range is a partition of its own.
    dealt = dealt.select("place.bucket", "place.extra", "key", "text").repartitionById(n, "bucket").sortWithinPartitions(
        "bucket", "extra", F.col("key").asc_nulls_first(), F.xxhash64("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return dealt.mapInArrow(_comparing(chunking), (
        f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")).withColumnRenamed("key", id_column)
