import sys

from pyspark.sql import functions as F

from triptych.functions.formats import cost_text, mean_text, rate_text
from triptych.functions.text import NA_TEXTS, WHITESPACE, na_to_null, strip, truthy


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


def test_strip_and_truthy(spark):
    texts = ["  a b\t", "\xa0x　\n", WHITESPACE, "", None, "\x1cz\x1f", "​q"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", strip(F.col("t")).alias("s"), truthy(strip(F.col("t"))).alias("ok")).orderBy("i").collect()
    assert [r.s for r in rows] == [t.strip() if t is not None else None for t in texts]
    assert [r.ok for r in rows] == [bool(t and t.strip()) for t in texts]


def test_na_texts(spark):
    keep = ["na", "NA ", "none", "0", "Null"]
    rows = spark.createDataFrame([(t,) for t in [*NA_TEXTS, *keep]], "t string").select(
        na_to_null(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [None] * 19 + keep


def test_formats_round_like_python(spark):
    numbers = [0.125, 0.375, 1.005, 2.675, 1234567.891, 0.0, -0.5, 1 / 3, 0.42333333, float("nan")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select(
        "i", mean_text(F.col("x")).alias("m"), rate_text(F.col("x")).alias("r"),
        cost_text(F.col("x")).alias("c")).orderBy("i").collect()
    assert [r.m for r in rows] == [f"{x:.2f}" for x in numbers]
    assert [r.r for r in rows] == [f"{x:.2%}" for x in numbers]
    assert [r.c for r in rows] == [f"${x:.4f}" for x in numbers]
