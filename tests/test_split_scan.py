"""Quoted files with line breaks, read in blocks, against the whole-file reader."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triptych.sources.readers import read_table
from triptych.sources.split_scan import read_split, record_lines


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content.encode())
    return str(path)


CONTENT = ('id,text,note\n'
           '1,"one\nline break, and ""quotes""",a\n'
           '2,plain,b\n'
           '3,"' + "long\n" * 40 + '",c\n'
           '\n'
           '4,"ends in quote""\r\nand CR LF",\n'
           '5,,"x\n\ny"\n'
           '6,"a field with a comma, ""and"" a ""quoted\nbreak""",z\n')


def test_equal_to_whole_file_read(spark, tmp_path, small_blocks):
    path = write(tmp_path, "a.csv", CONTENT)
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    blocks = read_split(spark, path)
    whole = read_table(spark, path)
    cols = ["id", "text", "note"]
    assert sorted(map(tuple, blocks.select(cols).collect())) == sorted(map(tuple, whole.select(cols).collect()))
    ordered = [r.id for r in blocks.orderBy("_file", "_block", "_line").collect()]
    assert ordered == ["1", "2", "3", "4", "5", "6"]


def test_several_files_and_many_rows(spark, tmp_path, small_blocks):
    body = "".join(f'{i},"row {i}\nsecond ""line""",{i % 3}\n' for i in range(300))
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("x.csv", "y.csv"):
        write(folder, name, "id,text,note\n" + body)
    got = read_split(spark, str(folder))
    assert got.count() == 600
    assert got.filter(F.col("text") != F.concat(F.lit("row "), "id", F.lit('\nsecond "line"'))).count() == 0


def test_records_keep_carriage_returns_in_quotes_only(spark, tmp_path, small_blocks):
    path = write(tmp_path, "r.csv", 'h\r\n"a\r\nb"\r\n')
    assert sorted(r.text for r in record_lines(spark, path).collect()) == ['"a\r\nb"\r', "h\r"]
    assert [r.h for r in read_split(spark, path).collect()] == ["a\r\nb"]


def test_texts_are_shuffled_once(spark, tmp_path, small_blocks):
    path = write(tmp_path, "a.csv", CONTENT)
    plan = record_lines(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_a_header_over_several_blocks(spark, tmp_path, small_blocks):
    folder = tmp_path / "long"
    folder.mkdir()
    header = '"' + "long name\n" * 30 + '",b\n'
    for name in ("1.csv", "2.csv"):
        write(folder, name, header + f"{name},2\n")
    assert sorted(r[0] for r in read_split(spark, str(folder)).collect()) == ["1.csv", "2.csv"]
    write(folder, "3.csv", header.replace(",b", ",c") + "3.csv,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_split(spark, str(folder))


def test_wrong_rows_and_headers_stop(spark, tmp_path):
    wide = write(tmp_path, "w.csv", "a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        read_split(spark, wide).collect()
    folder = tmp_path / "two"
    folder.mkdir()
    write(folder, "1.csv", "a,b\n1,2\n")
    write(folder, "2.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_split(spark, str(folder))
    short = write(tmp_path, "s.csv", "a,b\n1\n")
    assert [tuple(r) for r in read_split(spark, short).select("a", "b").collect()] == [("1", None)]
    only = write(tmp_path, "o.csv", "a,b\n")
    assert read_split(spark, only).count() == 0
