"""Removal of repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest

from triptych.llm import queries
from triptych.llm import substring_dedup as S

SMALL = "/root/testdata/sf0.01"


def brute(rows, window=13):
    """For each row: words, removed, kept text."""
    last = 1 << 63
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()) for _, text in rows]
    low: dict = {}
    for (key, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            name = tuple(w[i:i + window])
            low[name] = min(low.get(name, last), last if key is None else key)
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if low[tuple(w[i:i + window])] < (last if key is None else key):
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_names():
    names = S.WordNames()
    texts = ["", " ", "a", "ab ba\tab", "x" * 1000 + " é\xa0b\n\x0bab ", " lead"]
    by_word: dict = {}
    for text in texts:
        data = text.encode()
        found = names.of(np.frombuffer(data, np.uint8)).tolist()
        assert len(found) == len(data.split())
        for word, name in zip(data.split(), found, strict=True):
            assert by_word.setdefault(word, name) == name
    assert len(set(by_word.values())) == len(by_word)
    base = np.arange(40, dtype=np.uint64)
    for length in (1, 2, 3, 6, 13, 40, 41):
        found = S.stretches(base, length)
        assert len(found) == max(0, 41 - length) == len(set(found.tolist()))
        if length < 40:
            assert (S.stretches(np.r_[base[5:], base[:5]], length)[:10] == found[5:15])[:max(0, len(found) - 5)].all()


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_have_equal_revealing_names(seed):
    rng = random.Random(seed)
    base = S.mixed(np.array(rng.choices(range(1, 4 if seed % 2 else 50), k=400), np.uint64))
    if seed > 1:
        base[100:150] = base[100]
    for start in range(0, 300, 37):
        other = np.r_[S.mixed(np.array(rng.choices(range(100, 120), k=9), np.uint64)), base[start:start + 60]]
        assert (S.revealing(base, 13, 6)[start:start + 48] == S.revealing(other, 13, 6)[9:57]).all()


def documents(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([3, 30, 300]))] + ["é", "The"]
    passages = [rng.choices(vocabulary, k=rng.randrange(10, 40)) for _ in range(6)] + [["The"] * 30, ["ab", "cd"] * 12]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choices(vocabulary, k=rng.randrange(20)) + rng.choice([[], rng.choice(passages)])
        rows.append((rng.choice([i, i * 7 % 50, 1000 - i]), rng.choice([" ", "  ", "\n"]).join(words)))
    return rows + rows[:5] + [(5000, rows[3][1]), (5001, rows[3][1]), (None, rows[7][1]), (None, "x " * 20), (6000, None),
                              (6001, ""), (6002, "one"), (6003, "é\xa0" * 30), (1, "x " * 20000), (7000, "x " * 300)]


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup(make_docs, seed):
    rows = documents(seed)
    docs = make_docs(rows)
    got = S.substring_dedup(docs, keep_text=True)
    want = [(key, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (key, _), (n, gone, kept) in zip(
        rows, brute(rows), strict=True)]
    found = got.collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=order) == sorted(want, key=order)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found if r.kept_text is not None)
    assert {r.kept_text is None for r in found if r.n_removed} <= {False}


def test_other_sizes_and_empty_tables(make_docs):
    rows = documents(9)
    docs = make_docs(rows)
    found = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in S.substring_dedup(docs, window=8, reveal=3).collect())
    assert found == sorted((str(key), n, gone) for (key, _), (n, gone, _) in zip(rows, brute(rows, 8), strict=True))
    assert S.substring_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="less than window"):
        S.substring_dedup(docs, window=4)


def test_names_that_meet_over_many_batches(spark):
    """One name with thousands of rows, in small batches: what is held is one row."""
    rows = [(k, d, False) for k in range(5) for d in range(1 if k == 3 else 200)] + [(9, 77, True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.createDataFrame(rows, "key long, doc long, known boolean")
        for later, first in ((True, 1), (False, 0)):
            got = {r.doc: sorted(r["keys"]) for r in S._meet(frame, ["key"], later).collect()}
            assert got == {d: [0, 1, 2, 4] + [9] * (d == 77) for d in range(first, 200)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
def test_all_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_substring_dedup(spark, SMALL).collect()}
    assert got == {key: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (key, _), (n, gone, kept) in zip(
        rows, brute(rows), strict=True)}
    assert sum(n > 0 for _, n, _ in got.values()) > 50
