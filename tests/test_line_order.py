"""Replies by line order: places across files and blocks, void tasks, bad lines."""

from __future__ import annotations

import json

import pytest

from triptych.sources.line_order import numbered_lines, replies_by_order


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def lay(folder, task, chunks):
    where = folder / f"task={task}"
    where.mkdir(parents=True)
    for i, lines in enumerate(chunks):
        (where / f"part-{i:05d}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))


def test_places_follow_files_and_lines(spark, tmp_path, small_blocks):
    lay(tmp_path / "r", "T1", [[{"seg_id": i} for i in range(0, 30)], [], [{"seg_id": i} for i in range(30, 45)]])
    lay(tmp_path / "r", "T2", [[{"seg_id": i} for i in range(100, 103)]])
    got = numbered_lines(spark, str(tmp_path / "r")).collect()
    assert sorted((r.task, r.place, json.loads(r.value)["seg_id"]) for r in got) == (
        [("T1", i, i) for i in range(45)] + [("T2", i, 100 + i) for i in range(3)])
    (tmp_path / "flat.txt").write_text("a\n\nb\n")
    assert sorted((r.task, r.place, r.value) for r in numbered_lines(spark, str(tmp_path / "flat.txt")).collect()) == [
        ("", 0, "a"), ("", 1, ""), ("", 2, "b")]


def test_replies_attach_by_place_and_void_tasks(spark, tmp_path, small_blocks):
    asked = [[{"seg_id": i, "source": "s"} for i in range(0, 20)], [{"seg_id": i} for i in range(20, 25)]]
    lay(tmp_path / "q", "A", asked)
    lay(tmp_path / "q", "B", asked)
    lay(tmp_path / "a", "A", [[{"prediction": i / 10} for i in range(7)], [{"prediction": i / 10} for i in range(7, 25)]])
    lay(tmp_path / "a", "B", [[{"prediction": 1.0} for _ in range(24)]])  # one line short: void
    got = replies_by_order(spark, str(tmp_path / "q"), str(tmp_path / "a")).collect()
    assert sorted((r.seg_id, r.task, r.prediction) for r in got) == [(i, "A", i / 10) for i in range(25)]


def test_bad_lines(spark, tmp_path):
    lay(tmp_path / "q", "A", [[{"seg_id": 1}, {"seg_id": 2}]])
    lay(tmp_path / "a", "A", [[{"prediction": "x"}, {"prediction": 0.5}]])
    with pytest.raises(Exception, match="not a prediction"):
        replies_by_order(spark, str(tmp_path / "q"), str(tmp_path / "a")).collect()
    got = replies_by_order(spark, str(tmp_path / "q"), str(tmp_path / "a"), on_bad="drop").collect()
    assert [(r.seg_id, r.prediction) for r in got] == [(2, 0.5)]


def test_lines_are_numbered_without_a_shuffle_of_their_texts(spark, tmp_path, small_blocks):
    lay(tmp_path / "r", "A", [[{"seg_id": i} for i in range(30)]])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = numbered_lines(spark, str(tmp_path / "r"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted((r.place, json.loads(r.value)["seg_id"]) for r in got.collect()) == [(i, i) for i in range(30)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
