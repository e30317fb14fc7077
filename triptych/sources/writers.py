"""Sinks: dataset, scorer requests, per-segment results and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.operators.tasks import CANDIDATE, NINE_TASKS, Task, expand_tasks

# All nine tasks hold each text six times, uncompressed: more of it than this is not laid down at once.
REQUEST_BYTES = 256 << 20


def output_path(root: str, metric: str, language: str) -> str:
    """One folder per metric and language; writers create and overwrite it."""
    return f"{root.rstrip('/')}/{metric}/{language}"


def write_table(df: DataFrame, path: str) -> None:
    """A delimited table with a header that `read_table` reads back unchanged."""
    (df.write.mode("overwrite")
     .options(header=True, quote='"', escape='"', encoding="UTF-8", nullValue="",
              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
     .csv(path))


def request_rows(triples: DataFrame, tasks: Sequence[Task] = NINE_TASKS,
                 keys: Sequence[str] = ("seg_id",)) -> DataFrame:
    """What an outside scorer is sent; reference-free tasks have the empty text as reference.

    A missing hypothesis is not sent: `attach_scores` gives it no score. A source or reference
    that is missing stays so (its field is left out of JSON), for the scorer to decide.
    """
    return expand_tasks(triples, tasks, keys).filter(F.col("hyp").isNotNull()).select(
        *keys, "task",
        F.col("src").alias("source"),
        F.col("hyp").alias("hypothesis"),
        F.when(F.col("is_qe"), F.lit("")).otherwise(F.col("ref")).alias("reference"))


def write_requests(triples: DataFrame, path: str, tasks: Sequence[Task] = NINE_TASKS,
                   keys: Sequence[str] = ("seg_id",)) -> None:
    """Requests as JSON lines, one folder per task."""
    (request_rows(triples, tasks, keys)
     .write.mode("overwrite").partitionBy("task").json(path))


def request_groups(triples: DataFrame, tasks: Sequence[Task] = NINE_TASKS,
                   most: int = REQUEST_BYTES) -> list[list[Task]]:
    """The tasks in their order, in groups whose requests hold `most` bytes of text; one task at least.

    A scorer that is sent one group after the other, whose requests are dropped when they are
    answered, needs disk for one group. `triples` should be materialized: its texts are read.
    """
    texts = ("src", *CANDIDATE.values())
    sizes = triples.agg(*(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(c) for c in texts)).first()
    groups: list[list[Task]] = []
    room = 0
    for task in tasks:
        need = sizes["src"] + sizes[CANDIDATE[task.hyp]] + (sizes[CANDIDATE[task.ref]] if task.ref else 0)
        if not groups or need > room:
            groups.append([])
            room = most
        groups[-1].append(task)
        room -= need
    return groups


def write_results(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Original columns and score columns, one row per segment."""
    if file_format == "csv":
        write_table(df, path)
    else:
        df.write.mode("overwrite").format(file_format).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A frame of one `report` text per row, for instance from `report_json`."""
    report.select("report").write.mode("overwrite").text(path)
