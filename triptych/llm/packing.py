"""Packing by powers of two: each piece is a sequence, and none crosses documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triptych.llm.common import SLICE_BYTES, slices, whole_text
from triptych.llm.tokens import WordIds
from triptych.sources.shared import materialize


def cuts(n_tokens: int, longest: int) -> list[int]:
    """Lengths of a document's pieces: `longest` as often as it fits, then the binary digits of the rest."""
    rest = n_tokens % longest
    return [longest] * (n_tokens // longest) + [
        1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def _cutting(path: str, longest: int, end_id: int, keep_ids: bool,
             slice_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        part = TaskContext.get().partitionId()
        used: dict[int, int] = {}
        for batch in batches:
            for some in slices(batch, "text", slice_bytes):
                rows: list[list] = [[] for _ in range(8 if keep_ids else 7)]
                encoded = words.encode(some.column("text").to_pylist())
                for row, body in enumerate(encoded):
                    ids = np.append(body, np.uint32(end_id)).astype("<u4")
                    start = 0
                    for length in cuts(len(ids), longest):
                        piece = ids[start:start + length].tobytes()
                        rank = used.get(length, 0)
                        used[length] = rank + 1
                        for column, value in zip(rows, (
                                row, start, length, zlib.crc32(piece), len(ids), part, rank, piece), strict=False):
                            column.append(value)
                        start += length
                keys = some.column("key").take(pa.array(rows[0], pa.int64()))
                longs = [pa.array(c, pa.int64()) for c in rows[1:7]]
                yield pa.RecordBatch.from_arrays(
                    [keys, *longs, *(pa.array(c, pa.binary()) for c in rows[7:])],
                    ["key", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", *["ids"] * keep_ids])
    return run


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
         longest: int = 2048, end_id: int = 1, keep_ids: bool = True,
         slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per piece: the document's id, `start`, `length`, `ids_crc32`, `doc_tokens`,
    `sequence_id`, `offset` and, with `keep_ids`, the piece itself as `ids` (little-endian
    unsigned 32-bit numbers).

    `tokenizer` is a byte-level file of the tokenizers library; it must have the same place
    on every executor. A document's ids, with `end_id` after them, are cut into pieces of
    `longest` (a power of two) and then of the binary digits of what is left. Every piece
    is a sequence of its own, so nothing is padded and no sequence crosses documents.
    Sequences of one length are numbered one after the other, shorter lengths first, so a
    range of numbers is a bucket of equal lengths for batches.

    The pieces are written once to the shared folder with the task and the place in it
    where they were made; only counts per task and length are put in order to number them.

    NULL counts as the empty text, whose one piece is the end id. A document that occurs
    twice is packed twice. Other columns of `docs` are not carried.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    texts = docs.select(whole_text(text_column).alias("text"), F.col(id_column).alias("key"))
    out = (f"key {texts.schema['key'].dataType.simpleString()}, start long, length long, ids_crc32 long, "
           "doc_tokens long, part long, rank long" + ", ids binary" * keep_ids)
    pieces = materialize(texts.mapInArrow(
        _cutting(tokenizer, longest, end_id, keep_ids, slice_bytes), out), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.max("rank").alias("last"))
    n = F.col("last") + 1
    earlier = F.coalesce(F.sum(n).over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most one row for each length: a dozen.
    lengths = counts.groupBy("length").agg(F.sum(n).alias("all")).select("length", F.coalesce(F.sum("all").over(
        Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    # Written, so that Spark knows its size when it chooses how to join it with the pieces.
    first = materialize(counts.select("length", "part", earlier.alias("earlier")).join(
        F.broadcast(lengths), "length").select(
        "length", "part", (F.col("below") + F.col("earlier")).alias("first")), "firsts")
    return pieces.join(first, ["length", "part"]).select(
        F.col("key").alias(id_column), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *["ids"] * keep_ids)
