"""Exact and near duplicates, and components, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from triptych.llm import exact_dedup, simhash_dedup
from triptych.llm.components import components

TEXTS = [(5, "a b  c"), (3, "a b c"), (9, "a\tb\n c"), (4, "a b c "), (1, None), (2, ""), (7, "x" * 300_000),
         (8, "x" * 299_999 + "y"), (6, "x" * 300_000), (None, "a b c"), (None, "only null"), (3, "a b c"), (11, " "),
         (12, "\n\r"), (13, "é\xa0é"), (14, "é é")]


def check_exact(rows, got):
    groups: dict = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text or ""), []).append(key)
    assert len(got) == len(rows)
    for text, keys in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        keep = min((k for k in keys if k is not None), default=None)
        assert sorted((r.doc_id is None, r.doc_id) for r in mine) == sorted((k is None, k) for k in keys)
        assert {r.keep_id for r in mine} == {keep} and {r.group_size for r in mine} == {len(keys)}
        assert [r.doc_id for r in mine if r.kept] == [keep]


def test_exact_dedup(make_docs):
    docs = make_docs(TEXTS)
    judged = exact_dedup.exact_dedup(docs, chunk_bytes=1000)
    check_exact(TEXTS, judged.collect())
    kept = exact_dedup.keep_first(docs, judged)
    assert kept.columns == docs.columns and kept.count() == len({r.text_sha256 for r in judged.collect()})
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_clashing_fingerprints_are_told_apart(make_docs):
    rows = [(i, t) for i, t in enumerate(["abc", "acb", "bac", "abc", "cab", "xyz", "zyx", "abc", "acb"])]
    # Base 1 adds the bytes up, so all orders of the same letters clash.
    check_exact(rows, exact_dedup.exact_dedup(make_docs(rows), chunk_bytes=2, bases=((1, 1), (1, 1), (7, 11))).collect())
    with pytest.raises(ValueError, match="no bases left"):
        exact_dedup.exact_dedup(make_docs(rows), bases=((1, 1),)).collect()


def test_chunks_combine_to_the_value_of_the_whole():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    values = {exact_dedup.Polynomial(12345, 2_147_483_647, size).value(data) for size in (1, 7, 64, 4999, 5000, 9000)}
    direct = 0
    for byte in data.tolist():
        direct = (direct * 12345 + byte) % 2_147_483_647
    assert values == {(5000, direct)}


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n
    for u, v in links:
        u, v = find(u), find(v)
        parent[max(u, v)] = min(u, v)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    rng.shuffle(links)
    nodes = {n for link in links for n in link}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = union_find(nodes, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [words[i:i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def test_anchors_cover(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randrange(3)):
            y ^= 1 << bit
        rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    pairs = spark.createDataFrame([*rows, (0, 0), (-1, -1), (0, -(1 << 63))], "x long, y long")
    for r in pairs.select("x", "y", simhash_dedup.anchors(pairs.x).alias("a"), simhash_dedup.anchors(pairs.y).alias("b")).collect():
        assert len(r.a) <= 33 and len(set(r.a)) == len(r.a) and set(r.a) & set(r.b)
        assert all(((a ^ r.x) & (1 << 64) - 1).bit_count() <= 2 for a in r.a)


def test_simhash_groups(make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choices(words, k=60) for _ in range(8)]
    rows = [(100, None), (101, ""), (102, "\t"), (50, "One"), (51, "oNE"), (52, "a b"), (None, "a b"), (53, "É b c d"),
            (54, "é b c d")]
    for n in range(250):
        text = list(base[n % 8])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((1000 - n, " ".join(text).title() if n % 5 == 0 else "  ".join(text)))
    rows.append(rows[-1])
    docs = make_docs(rows)
    judged = simhash_dedup.simhash_groups(docs)
    got = judged.collect()
    prints = {slow_simhash(text) for _, text in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    root = union_find(prints, links)
    low: dict = {}
    for key, text in rows:
        low.setdefault(root[slow_simhash(text)], []).append(key)
    smallest = {r: min((k for k in keys if k is not None), default=None) for r, keys in low.items()}
    want = [(key, f"{slow_simhash(text):016x}", smallest[root[slow_simhash(text)]]) for key, text in rows]
    order = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=order) == sorted(want, key=order)
    kept = simhash_dedup.keep_one(docs, judged)
    assert kept.columns == docs.columns and kept.count() == len(smallest)
    assert simhash_dedup.simhash_groups(docs.limit(0)).count() == 0


def test_many_fingerprints_at_an_anchor():
    prints = np.unique(np.array([1 << i | 1 << j for i in range(64) for j in range(64)], np.uint64))
    links = simhash_dedup._links(prints, 2)
    assert links.shape[1] < len(prints)
    root = union_find(prints.tolist(), links.T.tolist())
    assert len(set(root.values())) == 1
    assert np.array_equal(simhash_dedup._bit_counts(np.full(70_000, 5, np.uint64))[-3:], [70_000, 0, 70_000])
