"""A sample of a fixed size per stratum."""

from __future__ import annotations

from triptych.operators.cleaning import _SAMPLE_RANGE, _SAMPLE_STEP, review_sample_per_stratum


def test_exactly_k_per_stratum(spark):
    rows = [(i, "hot" if i % 3 else ("a" if i % 2 else None)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, s string").repartition(7)
    got = review_sample_per_stratum(frame, ["s"], "id", 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.s, []).append(r.id)
    assert {s: len(v) for s, v in by.items()} == {"hot": 10, "a": 10, None: 10}
    for s, ids in by.items():
        members = [i for i, t in rows if t == s]
        want = sorted(members, key=lambda i: (i % _SAMPLE_RANGE * _SAMPLE_STEP % _SAMPLE_RANGE, i))[:10]
        assert sorted(ids) == sorted(want)
    again = review_sample_per_stratum(frame.repartition(3), ["s"], "id", 10).collect()
    assert sorted((r.s or "", r.id) for r in again) == sorted((r.s or "", r.id) for r in got)


def test_small_strata_and_text_keys(spark):
    frame = spark.createDataFrame([("x", "k1"), ("x", "k2"), ("y", None)], "s string, key string")
    got = review_sample_per_stratum(frame, ["s"], "key", 5).collect()
    assert sorted((r.s, r.key) for r in got) == [("x", "k1"), ("x", "k2"), ("y", None)]
    assert review_sample_per_stratum(frame.limit(0), ["s"], "key", 5).count() == 0
