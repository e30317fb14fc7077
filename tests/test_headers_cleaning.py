import random

import pytest
from pyspark.sql import functions as F

from triptych.operators.cleaning import drop_incomplete, first_rows, review_sample
from triptych.operators.headers import find_header, require_columns, resolve_roles, trim_headers
from triptych.operators.ordinal import with_ordinal
from triptych.sources.profiles import PROFILES


@pytest.mark.parametrize(("columns", "wanted", "found"), [
    (["Target A", "Target A (Figurative)"], ["Target A (Figurative)", "Target A"], "Target A (Figurative)"),
    (["German Target A (Figurative)", "Target A"], ["Target A (Figurative)", "Target A"],
     "German Target A (Figurative)"),
    (["My Target A", "Target A"], ["Target A"], "Target A"),
    (["x Target A", "y Target A"], ["Target A"], "x Target A"),
    (["target a"], ["Target A"], None),
    (["My Target A", "Target A"], ["Nope", "Target A"], "Target A"),
    ([], ["Target A"], None),
])
def test_find_header(columns, wanted, found):
    assert find_header(columns, wanted) == found


def test_roles_and_trimming(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], [" English Sentence", "Target A\t", "Target B", "Target C "])
    df = trim_headers(df)
    assert resolve_roles(df.columns, PROFILES["de"].headers) == {
        "src": "English Sentence", "cand_a": "Target A", "cand_b": "Target B", "cand_c": "Target C"}
    with pytest.raises(ValueError, match="cand_b"):
        resolve_roles(["English Sentence", "Target A", "Target C"], PROFILES["de"].headers)
    with pytest.raises(ValueError, match="same name"):
        trim_headers(spark.createDataFrame([(1, 2)], ["a", " a"]))
    with pytest.raises(ValueError, match="zz"):
        require_columns(df, ["Target A", "zz"])


def test_ordinals_are_exact_for_any_layout(spark):
    draw = random.Random(3)
    rows = [(draw.randint(0, 30), i, "t" * (i % 5)) for i in range(3000)]
    draw.shuffle(rows)
    want = {r[1]: n for n, r in enumerate(sorted(rows))}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "a int, b int, t string").repartition(parts)
        got = with_ordinal(df, ["a", "b"], "n")
        assert got.columns == ["a", "b", "t", "n"]
        assert {r.b: r.n for r in got.collect()} == want
    assert with_ordinal(df.filter("a > 99"), ["a", "b"]).count() == 0


def test_ordinals_of_equal_rows_are_an_error(spark):
    for rows in ([(1, "x"), (1, "y"), (2, "z")], [(None, "x"), (None, "y")]):
        with pytest.raises(Exception, match="several rows have one place"):
            with_ordinal(spark.createDataFrame(rows, "a int, b string"), ["a"]).collect()


def test_ordinals_need_no_task_with_every_row(spark):
    df = with_ordinal(spark.range(1000).repartition(4), ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    single = plan[plan.index("SinglePartition"):]
    assert "HashAggregate" in single.split("\n")[1]  # only partition sizes go there


def test_small_cleaners(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "y")], "k int, `p.q` string, r string")
    assert [r.k for r in drop_incomplete(df, ["p.q", "r"]).collect()] == [2]
    assert [r.k for r in first_rows(df, "k", 2).collect()] == [1, 2]
    ids = spark.range(50_000)
    sample = review_sample(ids, "id", 10)
    assert 4500 < sample.count() < 5500
    assert sample.exceptAll(review_sample(ids.repartition(3), "id", 10)).isEmpty()
    assert review_sample(ids, "id", 100).count() == 50_000 and review_sample(ids, "id", 0).count() == 0
    assert sample.filter(F.col("id") < 100).count() < 40
    named = ids.select(F.concat(F.lit("k"), "id").alias("k"))
    assert 4500 < review_sample(named, "k", 10).count() < 5500
