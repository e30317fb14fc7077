"""The pipeline against its stages in plain Python, and the queries with SQL against it."""

from __future__ import annotations

import re

import regex
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.test_dedup import slow_simhash, union_find
from tests.llm.test_mixing import plain_mix
from triptych.llm.oracle import ORACLE_SQL
from triptych.llm.queries import QUERIES
from triptych.llm.tokens import load_tokenizer
from triptych.sources.shared import materialize
from workload.trial import connect, differences

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    problem, rows = differences(spark, connect(SMALL), SMALL, name, QUERIES, ORACLE_SQL)
    assert not problem and rows > 0


def test_pipeline(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = [r for r in spark.read.parquet(f"{TINY}/documents.parquet").collect() if regex.search(r"\p{L}", r.text or "")]
    first: dict = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text), r)
    docs = list(first.values())
    prints = {r.doc_id: slow_simhash(r.text) for r in docs}
    distinct = sorted(set(prints.values()))
    root = union_find(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    low: dict = {}
    for r in docs:
        low.setdefault(root[prints[r.doc_id]], []).append(r.doc_id)
    docs = [r for r in docs if min(low[root[prints[r.doc_id]]]) == r.doc_id]
    want: Counter = Counter()
    whole = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for key, size, _, _, words, text in plain_mix([(r.doc_id, r.text, r.lang, r.source) for r in docs]):
        parts = [text] * (words // size) + ([" ".join(text.split()[:words % size])] if words % size else [])
        for part in parts:
            ids = np.array([*whole.encode(part, add_special_tokens=False).ids, 1], "<u4")
            want[key, len(ids), zlib.crc32(ids.tobytes())] += 1
    got: Counter = Counter()
    pieces = corpus_pipeline.run(spark, TINY).collect()
    # Copies of one document have equal pieces, so each start has as many as there are copies.
    by_copy: dict = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.doc_tokens, r.start, r.ids_crc32)):
        by_copy.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(bytes(r.ids))
    for (key, n), starts in by_copy.items():
        for i in range(len(starts[0])):
            got[key, n, zlib.crc32(b"".join(s[i] for _, s in sorted(starts.items())))] += 1
    assert got == want


def test_stages_on_odd_rows(spark, make_docs):
    """NULLs in any column, empty, blank and long texts, repeated rows, clashing names, an empty table."""
    rows = [(1, "the cat sat on the mat", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (None, None, None, None),
            (2, "", "en", None), (3, " \n", None, "b"), (4, "123 %", "en", "b"), (5, "der hund und die katze " * 9000, "de", "b"),
            (None, "another text without an id", None, None), (6, "wo ist das haus", "de", "c"), (7, "Wo  ist das haus", None, "c")]
    docs = make_docs(rows).withColumns({"score": F.lit(1), "lang_pred": F.lit("zz"), "a.b": F.lit(None).cast("int"),
                                        "taken": F.lit("x"), "kept": F.lit(False)})
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            n = frame.count()
            frame = materialize(stage(spark, frame, TINY), "odd")
            assert frame.dtypes == docs.dtypes, name
            assert n == 0 or frame.count() > 0
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, TINY)
        assert (packed.count() > 0) == (n > 0)
