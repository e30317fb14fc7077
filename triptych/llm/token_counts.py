"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.llm.common import SLICE_BYTES, slices, whole_text
from triptych.llm.tokens import WordCounts


def _counting(path: str, slice_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(path)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                n = counts.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(n, pa.int64())], [*part.schema.names[1:], "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id",
                 text_column: str = "text", limit: int = 2048,
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: its id, `n_bytes`, `n_tokens` and `over_limit`.

    `tokenizer` is a file of the tokenizers library, of a kind that drops white space; it
    must have the same place on every executor. Texts go to Python in Arrow batches, are
    taken in runs of about `slice_bytes` and split at white space, and lengths alone come
    back. Special strings inside a text count as the library has it by default: one token.

    NULL counts as the empty text, of 0 tokens. Repeated rows are counted each. Other
    columns of `docs` are not carried, whatever their names.
    """
    texts = docs.select(whole_text(text_column).alias("text"), F.col(id_column).alias("key"),
                        F.octet_length(whole_text(text_column)).cast("long").alias("n_bytes"))
    schema = texts.schema.fields
    out = f"key {schema[1].dataType.simpleString()}, n_bytes long, n_tokens long"
    return texts.mapInArrow(_counting(tokenizer, slice_bytes), out).select(
        F.col("key").alias(id_column), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))
