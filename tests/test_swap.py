"""Results replaced in one step: a failed write leaves the old result readable."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from triptych.sources.swap import current_version, read_swapped, write_swapped


def test_failed_write_keeps_the_old_result(spark, tmp_path):
    path = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        read_swapped(spark, path)
    write_swapped(spark.range(10).withColumn("v", F.lit("old")), path)
    assert {r.v for r in read_swapped(spark, path).collect()} == {"old"}
    # A job that fails in the middle of writing: some tasks have written files.
    failing = spark.range(0, 100, 1, 10).withColumn(
        "v", F.when(F.col("id") == 95, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="broken"):
        write_swapped(failing, path)
    assert {r.v for r in read_swapped(spark, path).collect()} == {"old"}
    assert read_swapped(spark, path).count() == 10
    write_swapped(spark.range(3).withColumn("v", F.lit("newer")), path)
    assert sorted(r.id for r in read_swapped(spark, path).collect()) == [0, 1, 2]
    for n in range(3):
        write_swapped(spark.range(n).withColumn("v", F.lit(str(n))), path)
    names = sorted(os.listdir(path))
    assert len([x for x in names if x.startswith("v-")]) == 2  # the newest and the one before
    assert len([x for x in names if x.startswith("_pointer-")]) == 2
    newest = [x for x in names if x.startswith("_pointer-")][-1]
    assert current_version(spark, path).endswith(open(os.path.join(path, newest)).read())


def test_other_formats(spark, tmp_path):
    path = str(tmp_path / "text")
    write_swapped(spark.createDataFrame([("a",), ("b",)], "value string"), path, "text")
    assert sorted(r.value for r in read_swapped(spark, path, "text").collect()) == ["a", "b"]
