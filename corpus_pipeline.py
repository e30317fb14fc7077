"""The corpus pipeline: documents in, packed sequences out.

Each stage is one operator of `triptych.llm`, takes the rows that the one before kept, and
returns rows with the columns of documents; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.llm import exact_dedup, language_id, mixing, packing, simhash_dedup
from triptych.llm.common import remainder, table
from triptych.sources.shared import materialize


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    model = language_id.train(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    return language_id.keep_identified(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal documents, that with the smallest id."""
    return exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return simhash_dedup.keep_one(docs, simhash_dedup.simhash_groups(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in whole or, at a source's cut, in part."""
    return mixing.take(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of lengths that are powers of two, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

# SQL can't express the language model and the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
