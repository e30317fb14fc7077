"""Alignment of two tokenizers against a plain version, document by document."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from triptych.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Per id: n_a, n_b, n_groups, links, sha; then the corpus counts."""
    tok = T.Aligner(A, B)
    per = []
    for doc_id, text in rows:
        if not text:
            per.append((doc_id, 0, 0, 0, [], ""))
            continue
        a = tok.a.encode(" " + text, add_special_tokens=False).ids
        b = tok.b.encode(text)
        data = (" " + text).encode()
        if b"".join(tok.a_bytes[i] for i in a) != data or b"".join(tok.b_bytes[i] for i in b) != data:
            per.append((doc_id, 0, 0, 0, [], ""))
            continue
        a_end, b_end, at = {}, {}, 0
        for i in a:
            at += len(tok.a_bytes[i])
            a_end[at] = i
        at = 0
        for i in b:
            at += len(tok.b_bytes[i])
            b_end[at] = i
        common = sorted(set(a_end) & set(b_end))
        groups, ga, gb, at = [], [], [], 0
        ends_a = list(a_end.items())
        ends_b = list(b_end.items())
        for end in common:
            ga = [i for e, i in ends_a if at < e <= end]
            gb = [i for e, i in ends_b if at < e <= end]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            at = end
        links = [(a_end[e], b_end[e]) for e in common]
        per.append((doc_id, len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(link for row in per for link in row[4])
    best = Counter()
    for (_, b), c in counts.items():
        best[b] = max(best[b], c)
    return {row[0]: (row[1], row[2], row[3], len(row[4]), sum(counts[x] == best[x[1]] for x in row[4]),
                     sum(counts[x] for x in row[4]), row[5]) for row in per}


TEXTS = ["Hello world, this is a text.", None, "", "Hello world, this is a text.", "  two  spaces\nand a line",
         "<|endoftext|> and <s> inside", "Ünïcødé text — with dashes ½ ² and 漢字", "x", "tab\there", "end ",
         "Hello world, this is a text.", "numbers 12345 678", "émoji 🙂 here"]


def test_measures_equal_plain(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    want = plain(rows)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
           for r in T.align(make_docs(rows), A, B).collect()}
    assert got == want
    assert got[0][0] > 0 and got[1] == (0, 0, 0, 0, 0, 0, "") and got[2] == got[1]


def test_long_texts_in_pieces(spark, make_docs, monkeypatch):
    text = " ".join(f"word{i % 97} Mixed-case text, with punctuation! and 12 numbers" for i in range(300))
    rows = [(0, text), (1, text + " tail"), (2, "short one")]
    whole = {r.doc_id: tuple(r) for r in T.align(make_docs(rows), A, B).collect()}
    monkeypatch.setattr(T, "PIECE_CHARS", 500)
    assert len(T.Aligner.pieces(None, text)) > 10
    pieced = {r.doc_id: tuple(r) for r in T.align(make_docs(rows), A, B).collect()}
    assert pieced == whole


def test_empty_table(spark, make_docs):
    assert T.align(make_docs([]), A, B).count() == 0


def test_byte_table():
    table = T.byte_level_table()
    assert len(table) == 256 and sorted(table.values()) == list(range(256))
    assert table["Ġ"] == 32 and table["A"] == 65


def test_null_and_repeated_ids_keep_their_rows(spark, make_docs):
    rows = [(None, "same text"), (None, "same text"), (5, "same text"), (5, "other text")]
    got = sorted((r.doc_id is None, r.n_a) for r in T.align(make_docs(rows), A, B).collect())
    assert len(got) == 4 and all(n > 0 for _, n in got)


def test_tiktoken_ranks_give_the_same_ids(spark, make_docs):
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    fast, plain_aligner = T.Aligner(A, B, ranks), T.Aligner(A, B)
    assert fast.a_bytes == plain_aligner.a_bytes[:len(fast.a_bytes)] and len(fast.a_bytes) == 50256
    import pandas as pd
    texts = TEXTS[2:] + pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.tolist()[:300]
    for text in texts:
        t = " " + (text or "")
        assert fast.fast.encode_ordinary(t) == plain_aligner.a.encode(t, add_special_tokens=False).ids
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    want = plain(rows)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
           for r in T.align(make_docs(rows), A, B, a_ranks=ranks).collect()}
    assert got == want
