"""A journal of replies: a stopped round pays only for what is missing; changed prompts are asked anew."""

from __future__ import annotations

import os
import uuid

import pytest

from triptych.operators.journal import JournaledGenerator
from triptych.operators.stages import Stage, run_stage


class Stop(BaseException):
    """Not an Exception: it stops the task, as a lost executor would."""


def counting(log, stop_after=None):
    def build():
        def ask(prompt):
            if stop_after is not None and len(os.listdir(log)) >= stop_after:
                raise Stop("stopped")
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return '{"a": "' + prompt + '"}', 1, 1
        return ask
    return build


def calls(log):
    return sorted(open(f"{log}/{name}").read() for name in os.listdir(log))


def test_stopped_round_pays_only_for_what_is_missing(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "idiom_id long, prompt string")
    journal = str(tmp_path / "journal")
    with pytest.raises(Exception, match="stopped"):
        JournaledGenerator(counting(log, stop_after=10), journal, batch_rows=4, spread=1).reply(
            prompts, "s", 1).collect()
    first = len(calls(log))
    assert first == 10  # two batches of four committed, two calls of the third lost
    answered = JournaledGenerator(counting(log), journal, batch_rows=4, spread=1).reply(prompts, "s", 1)
    rows = sorted((r.idiom_id, r.response) for r in answered.collect())
    assert rows == [(i, '{"a": "p' + str(i) + '"}') for i in range(20)]
    assert len(calls(log)) - first == 12  # the 20 rows less the 8 in the journal


def test_changed_prompts_and_new_rows_are_asked_on_resume(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    stage, store, journal = Stage("s", ("a",)), str(tmp_path / "store"), str(tmp_path / "journal")
    first = spark.createDataFrame([(1, "old prompt"), (2, "same")], "idiom_id long, prompt string")
    run_stage(stage, first, JournaledGenerator(counting(log), journal), store, resume=True)
    assert calls(log) == ["old prompt", "same"]
    second = spark.createDataFrame([(1, "new prompt"), (2, "same"), (3, "added")], "idiom_id long, prompt string")
    result = run_stage(stage, second, JournaledGenerator(counting(log), journal), store, resume=True)
    assert sorted((r.idiom_id, r.a) for r in result.replies.collect()) == [(1, "new prompt"), (2, "same"), (3, "added")]
    assert calls(log) == ["added", "new prompt", "old prompt", "same"]
    again = run_stage(stage, second, JournaledGenerator(counting(log), journal), store, resume=True)
    assert again.replies.count() == 3 and len(calls(log)) == 4


def test_errors_are_attempts_and_repeated_rows_ask_once(spark, tmp_path):
    def build():
        def ask(prompt):
            if prompt == "bad":
                raise TimeoutError("late")
            return "x", 2, 3
        return ask
    prompts = spark.createDataFrame([(1, "bad"), (2, "ok"), (2, "ok")], "idiom_id long, prompt string")
    got = sorted(tuple(r) for r in JournaledGenerator(build, str(tmp_path / "j")).reply(prompts, "s", 1).collect())
    assert got == [(1, "bad", None, None, None, "TimeoutError: late"), (2, "ok", "x", 2, 3, None),
                   (2, "ok", "x", 2, 3, None)]
