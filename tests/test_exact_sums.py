"""Exact means: equal to the last bit for any partitioning, and exactly rounded."""

from __future__ import annotations

import math
import random
from fractions import Fraction

from triptych.operators.exact_sums import exact_means


def exact(values):
    return float(sum(map(Fraction, values), Fraction(0)) / len(values))


def test_same_bits_for_any_partitioning(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([1e300, -1e300, 1.0, 1e-300, 5e-324, -3.5]) * rng.random(), rng.uniform(-1, 1))
            for g in ("a", "b", None) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    results = []
    for parts in (1, 7, 200):
        got = exact_means(frame.repartition(parts), ["x", "y"], ["g"]).collect()
        results.append(sorted((r.g or "", r.task, r.average.hex()) for r in got))
    assert results[0] == results[1] == results[2]
    for g in ("a", "b", None):
        for column, at in (("x", 1), ("y", 2)):
            want = exact([r[at] for r in rows if r[0] == g])
            assert (g or "", column, want.hex()) in results[0]


def test_nan_inf_null_and_empty(spark):
    rows = [(1, 1.0), (1, float("nan")), (2, float("inf")), (2, 1.0), (3, float("inf")), (3, float("-inf")),
            (4, None), (5, 0.0), (5, -0.0), (6, 2.0), (6, None)]
    frame = spark.createDataFrame(rows, "k int, x double")
    kept = {r.k: r.average for r in exact_means(frame, ["x"], ["k"]).collect()}
    assert math.isnan(kept[1]) and kept[2] == math.inf and math.isnan(kept[3])
    assert kept[4] is None and kept[5] == 0.0 and kept[6] == 2.0
    skipped = {r.k: r.average for r in exact_means(frame, ["x"], ["k"], nan="skip").collect()}
    assert skipped[1] == 1.0
    assert exact_means(frame.limit(0), ["x"], ["k"]).count() == 0
    assert [r.average for r in exact_means(frame.filter("k = 6"), ["x"]).collect()] == [2.0]
