"""Scoring tasks: which candidate is judged, and against what."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("A", "B", "C")
CANDIDATE = {"A": "cand_a", "B": "cand_b", "C": "cand_c"}


@dataclass(frozen=True)
class Task:
    """Judge candidate `hyp`, by candidate `ref` or, without one, by the source."""

    label: str
    hyp: str
    ref: str | None = None

    @property
    def reference_free(self) -> bool:
        return self.ref is None


QE_TASKS = tuple(Task(f"Score_QE_{hyp}", hyp) for hyp in ROLES)
REFERENCE_TASKS = tuple(Task(f"Score_{hyp}_Ref_{ref}", hyp, ref)
                        for ref in ROLES for hyp in ROLES if hyp != ref)
NINE_TASKS = QE_TASKS + REFERENCE_TASKS


def expand_tasks(triples: DataFrame, tasks: Sequence[Task] = NINE_TASKS,
                 keys: Sequence[str] = ("seg_id",)) -> DataFrame:
    """One row per triple and task: keys, task, src, hyp, ref, is_qe.

    `ref` is NULL in reference-free tasks. The table grows by the number of
    tasks, so scoring inside Spark uses `score_triples`, which does not need it.
    The name of a single task is a constant, by which no writer has to sort.
    """
    def columns(task: Task) -> list[Column]:
        return [F.lit(task.label).alias("task"),
                F.col(CANDIDATE[task.hyp]).alias("hyp"),
                (F.col(CANDIDATE[task.ref]) if task.ref else F.lit(None).cast("string")).alias("ref"),
                F.lit(task.reference_free).alias("is_qe")]

    if len(tasks) == 1:
        frame = triples.select(*keys, "src", *columns(tasks[0]))
    else:
        options = F.array(*(F.struct(*columns(t)) for t in tasks))
        frame = triples.select(*keys, "src", F.explode(options).alias("_task")).select(*keys, "src", "_task.*")
    return frame.select(*keys, "task", "src", "hyp", "ref", "is_qe")
