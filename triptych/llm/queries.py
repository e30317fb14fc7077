"""The registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.llm import (
    ann_forest,
    chunk_fingerprints,
    exact_dedup,
    html_extract,
    language_id,
    mixing,
    packing,
    quality,
    simhash_dedup,
    substring_dedup,
    token_alignment,
    token_counts,
    whitening,
)
from triptych.llm.common import remainder, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without passages of 13 words that an earlier one has."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal documents stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of lengths that are powers of two."""
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), keep_ids=False)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and the group that it is linked to."""
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document and of its edited text."""
    return chunk_fingerprints.chunk_fingerprints(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth one, by a forest of random-projection trees."""
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened on the sixteen leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document."""
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"),
                                 _tokenizer("piece_bpe_32k.model"),
                                 a_ranks=(_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {f.__name__: f for f in (
    op1_mix, op2_substring_dedup, op3_exact_dedup, op4_language_id, op5_html_extract, op6_packing,
    op7_simhash_dedup, op8_chunk_fingerprints, op9_token_counts, op10_quality, op11_ann_forest, op12_whitening,
    op13_token_alignment)}
