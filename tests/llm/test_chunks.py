"""Chunk fingerprints against a byte-by-byte version."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import xxhash

from triptych.llm import chunk_fingerprints as C


def slow_ends(data, gear, k):
    ends, start, n = [], 0, len(data)
    value, hashes = 0, []
    for byte in data:
        value = (value << 1) + int(gear[byte]) & 0xFFFFFFFF
        hashes.append(value)
    while n - start > k.least:
        end = min(start + k.most, n)
        for at in range(start + k.least, end):
            zeros = k.bits + 1 if at < start + k.usual else k.bits - 1
            if hashes[at - 1] >> 32 - zeros == 0:
                end = at
                break
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def test_boundaries(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 1000)
    gear, rng = C.gear_table(), random.Random(2)
    for n in (0, 1, 15, 16, 17, 63, 64, 300, 999, 1000, 1001, 5000):
        data = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        assert C.chunk_ends(np.frombuffer(data, np.uint8), gear, C.Chunking()) == slow_ends(data, gear, C.Chunking())


def test_chunk_fingerprints(make_docs):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    rows = [(i * 3, text(rng.choice([0, 1, 2, 50, 700, 3000]))) for i in range(60)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "zz" * 50_000), (-4, "first"), (None, "none")]
    docs = make_docs(rows)
    got = {r.doc_id: r for r in C.chunk_fingerprints(docs, range_bytes=5000).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    gear = C.gear_table()

    def chunks(t):
        data, start, out = t.encode(), 0, {}
        for end in slow_ends(data, gear, C.Chunking()):
            out[xxhash.xxh64_intdigest(data[start:end]) & 0xFFFFFFFFFF, end - start] = end - start
            start = end
        return out

    def inside(a, b):
        return sum(v for k, v in a.items() if k in b) / sum(a.values()) if a else float(not b)

    for (key, own), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        own, following = own or "", following or ""
        half = len(own) // 2
        changed = own[:len(own) - half] + following[:half]
        r = got[key]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{h:010x}{n:04x}" for h, n in sorted(chunks(own)))
        assert r.edited_fingerprint == " ".join(f"{h:010x}{n:04x}" for h, n in sorted(chunks(changed)))
        assert abs(r.near_edited - inside(chunks(own), chunks(changed))) < 1e-9
        assert abs(r.near_next - inside(chunks(own), chunks(following))) < 1e-9
    assert got[500].near_next == 1 and got[502].near_next == 1
    one = C.chunk_fingerprints(make_docs([(1, "abc")])).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert C.chunk_fingerprints(docs.limit(0)).count() == 0
    assert C.chunk_fingerprints(docs.union(docs)).count() == 2 * len(rows)
