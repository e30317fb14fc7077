"""Triples: one source sentence with its candidates A, B and C."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.formats import language_pair
from triptych.functions.text import exact
from triptych.operators.cleaning import drop_incomplete
from triptych.operators.ordinal import with_input_ordinal
from triptych.sources.readers import BLOCK_COLUMN, FILE_COLUMN, INPUT_ORDER

TEXTS = ("src", "cand_a", "cand_b", "cand_c")


def project_triples(df: DataFrame, roles: Mapping[str, str], key: str | None = None) -> DataFrame:
    """Complete triples of a table, with its own columns kept in `original`.

    `roles` names the columns of src, cand_a, cand_b and cand_c. `key` names a
    unique whole-number column to use as seg_id; without one, seg_id is the
    row's place among the complete rows of a frame read with `input_order`.
    """
    kept = drop_incomplete(df, [roles[r] for r in TEXTS])
    own = [c for c in df.columns if c not in INPUT_ORDER]
    if key is None:
        kept, seg_id = with_input_ordinal(kept, FILE_COLUMN, BLOCK_COLUMN, "_seg_id"), F.col("_seg_id")
    else:
        seg_id = exact(key).cast("long")
    return kept.select(seg_id.alias("seg_id"), *(exact(roles[r]).alias(r) for r in TEXTS),
                       F.struct(*(exact(c) for c in own)).alias("original"))


def gather_triples(rows: DataFrame, keys: Mapping[str, Column], position: Column,
                   text: Column, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Triples out of one text per row; a text that is not there gives NULL.

    `position` 0 is the source, 1 to 3 the candidates. `extra` columns are
    taken from the source row. The groups are small by nature (four rows) and
    are combined before the shuffle where they lie together.
    """
    columns = [F.max(F.when(position == i, text)).alias(name) for i, name in enumerate(TEXTS)]
    columns += [F.max(F.when(position == 0, value)).alias(name)
                for name, value in (extra or {}).items()]
    return rows.groupBy(*(value.alias(name) for name, value in keys.items())).agg(*columns)


def drop_incomplete_triples(triples: DataFrame) -> DataFrame:
    return drop_incomplete(triples, TEXTS)


def scorer_frame(pairs: DataFrame, target_code: str | Column,
                 keys: Sequence[str] = ("seg_id",)) -> DataFrame:
    """The columns a segment scorer expects, from src, hyp and ref."""
    return pairs.select(
        "src", F.col("hyp").alias("mt"), F.coalesce("ref", F.lit("")).alias("ref"),
        language_pair(target_code).alias("lp"), *keys,
        F.lit("sys").alias("system-name"), F.lit(0.0).alias("human_ratings"))
