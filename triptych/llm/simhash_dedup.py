"""Near duplicates by SimHash, found by covering the fingerprints with anchor points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.llm.common import one_row_each, whole_text
from triptych.llm.components import components
from triptych.sources.shared import materialize

SEED = 42
SHINGLE = 3
# Hashes whose bits are counted at a time, and rows that a byte can count.
BLOCK = 1 << 15
BYTE = 255


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        some = hashes[start:start + BLOCK]
        bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) // BYTE * BYTE
        if full:
            total += bits[:full].reshape(-1, BYTE, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.int64)
    return total


def simhash(data: bytes) -> int:
    """The fingerprint of a text in UTF-8: a bit is set if over half of the shingles' hashes have it."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - SHINGLE + 1))
    return int.from_bytes(np.packbits(_bit_counts(hashes) * 2 > len(hashes)).tobytes(), "big")


def _fingerprinting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((simhash(t.as_buffer().to_pybytes()) for t in batch.column("text")), np.uint64,
                             batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64))],
                                         [*batch.schema.names[1:], "print"])


def anchors(fingerprint: Column) -> Column:
    """The anchor points that a fingerprint of 64 bits is copied to, as an array.

    Anchors are the words of the Hamming code on the lower 63 bits, with the top bit free.
    Any point is within 1 of an anchor: this is the covering radius. Two points that differ
    in 2 bits have a point between them that is within 1 of both, and so an anchor that is
    within 2 of both. Each fingerprint goes to all anchors within 2: the covering radius,
    and the threshold's half on its side.

    A bit's place is its number from 1 to 63. Places of the set bits, added without carry,
    make the syndrome: 0 for a word of the code, else the place to flip to get one. Two
    flips get there if their places add up to the syndrome.
    """
    def one(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))

    masks = [sum(1 << (place - 1) for place in range(1, 64) if place >> digit & 1) for digit in range(6)]
    syndrome = sum(((F.bit_count(fingerprint.bitwiseAND(F.lit(mask))) % 2) * (1 << digit)
                    for digit, mask in enumerate(masks)), F.lit(0))
    nearest = F.when(syndrome == 0, fingerprint).otherwise(fingerprint.bitwiseXOR(one(F.greatest(syndrome, F.lit(1)))))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda a: a < a.bitwiseXOR(syndrome))
    return F.concat(
        F.array(nearest, nearest.bitwiseXOR(F.lit(-(1 << 63)))),
        F.transform(pairs, lambda a: fingerprint.bitwiseXOR(one(a)).bitwiseXOR(one(a.bitwiseXOR(syndrome)))))


def _links(prints: np.ndarray, threshold: int) -> np.ndarray:
    """Links that join what is within the threshold of each other, for the fingerprints of an anchor.

    Each fingerprint is linked to the smallest that it is joined to: no more links than fingerprints.
    """
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= threshold
    label = np.arange(len(prints))
    while True:
        lower = np.where(near, label[None, :], len(prints)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return np.stack([prints[moved], prints[label[moved]]])


def _comparing(threshold: int):
    def compared(anchor: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(anchor)])
        two = starts[sizes == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= threshold]
        found = [np.stack([prints[near], prints[near + 1]])]
        found += [_links(prints[start:start + size], threshold)
                  for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True)]
        links = np.unique(np.concatenate(found, axis=1), axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            anchor = np.r_[anchor, batch.column("anchor").to_numpy()]
            prints = np.r_[prints, batch.column("print").to_numpy().view(np.uint64)]
            if len(anchor):  # the last anchor may go on
                cut = int(np.searchsorted(anchor, anchor[-1]))
                yield compared(anchor[:cut], prints[:cut])
                anchor, prints = anchor[cut:], prints[cut:]
        yield compared(anchor, prints)
    return run


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   threshold: int = 2) -> DataFrame:
    """One row per document: its id, `fingerprint`, `component_id`, `kept` and `text_hash`.

    A-Z are lower-cased and words are `[^\\x20\\x09-\\x0D]+`; shingles are three words, repeats
    included (fewer words: the whole sequence). Fingerprints link at `threshold` (0 to 2) or
    fewer differing bits, and `component_id` is the smallest id that is reached over links.
    `kept` marks one row of each component, a row with that id.

    Texts that are NULL or without words have fingerprint zero, which is linked like any
    other. Rows with one id are all fingerprinted. NULL ids are never the smallest, unless a
    component has no other. Other columns are not carried; `text_hash` is xxhash64 of the
    text.

    From the fingerprints on, each distinct value counts once, however many documents have
    it. It is copied to its anchors (33 at most), and fingerprints are compared per anchor.
    An anchor has at most 2081 distinct fingerprints within 2, so these groups are bounded
    by geometry, and no more links leave a group than it has fingerprints.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds from 0 to 2")
    text = whole_text(text_column)
    rows = docs.select(text.alias("text"), F.col(id_column).alias("key"), F.xxhash64(text).alias("text_hash"))
    seen = materialize(rows.mapInArrow(
        _fingerprinting, f"key {rows.schema['key'].dataType.simpleString()}, text_hash long, print long",
    ).withColumn("row", F.monotonically_increasing_id()), "simhashes")
    first = F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("key"), F.col("row").alias("row"))
    prints = materialize(seen.groupBy("print").agg(F.min(first).alias("first")), "distinct-simhashes")
    copies = prints.select("print", F.explode(anchors(F.col("print"))).alias("anchor"))
    links = copies.repartition("anchor").sortWithinPartitions("anchor", "print").mapInArrow(
        _comparing(threshold), "u long, v long")
    roots = components(links)
    prints = prints.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    smallest = prints.groupBy("root").agg(F.min("first").alias("chosen"))
    prints = prints.join(smallest, "root").select("print", "chosen")
    return seen.join(prints, "print").select(
        F.col("key").alias(id_column), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("chosen.key").alias("component_id"), (F.col("row") == F.col("chosen.row")).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, grouped: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of `docs` for each component, `grouped` being the result of `simhash_groups` on them."""
    return one_row_each(docs, grouped.filter("kept"), id_column, text_column)
