"""Counting and packing against the tokenizers library on whole texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from triptych.llm import packing, token_counts
from triptych.llm.tokens import WordCounts, WordIds, load_tokenizer

tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello world, it's  we'll.  Don't!  ok..; \xaa,.", "", None, " ", "\n\n a\tb \r\n c  ", "a<|endoftext|>b <|startoftext|>",
    "é. é, x.y,z 12 345,6 ²½", "x　 y\x0b z\x85 \xa0 w", "中文 字。 ok", "word " * 3000, "z" * 20000, "Σας Σ. ΣΑΣ",
    "é ́a", "the and the."]


def test_parts_give_the_tokens_of_the_whole():
    whole, ids = load_tokenizer(BYTES), WordIds(BYTES, cache_words=5)
    for text in TEXTS:
        assert ids.encode([text or ""])[0].tolist() == whole.encode(text or "", add_special_tokens=False).ids
    whole, counts = load_tokenizer(WORDS), WordCounts(WORDS, cache_words=5)
    for text in TEXTS:
        assert counts.count([text or ""]) == [len(whole.encode(text or "", add_special_tokens=False).ids)]


def test_token_counts(make_docs):
    whole = load_tokenizer(WORDS)
    docs = make_docs(TEXTS)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, WORDS, limit=100, slice_bytes=50).collect()}
    for i, text in enumerate(TEXTS):
        n = len(whole.encode(text or "", add_special_tokens=False).ids)
        assert got[i].asDict() == {"doc_id": i, "n_bytes": len((text or "").encode()), "n_tokens": n,
                                   "over_limit": n > 100}
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0
    assert token_counts.token_counts(docs.union(docs), WORDS).count() == 2 * len(TEXTS)


def test_cuts():
    assert packing.cuts(0, 8) == [] and packing.cuts(1, 8) == [1]
    assert packing.cuts(29, 8) == [8, 8, 8, 4, 1] and packing.cuts(16, 8) == [8, 8]
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(None, BYTES, longest=12)


def test_pack(make_docs):
    whole = load_tokenizer(BYTES)
    docs = make_docs(TEXTS)
    rows = packing.pack(docs, BYTES, longest=64, slice_bytes=100).collect()
    by_doc: dict = {}
    for r in rows:
        assert r.offset == 0 and r.length <= 64 and r.length & (r.length - 1) == 0
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        want = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in pieces for x in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert {r.doc_tokens for r in pieces} == {len(want)}
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    # Numbers without gaps, shorter sequences first.
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_number = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number)
    assert packing.pack(docs.limit(0), BYTES).count() == 0
