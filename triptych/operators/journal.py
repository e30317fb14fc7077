"""A model asked through a journal: replies are committed per batch as they come, and a
stopped or repeated round asks only for what the journal lacks.

Each asked row carries a fingerprint: SHA-256 of the stage, the attempt and the prompt. The
journal is a folder of Parquet files per (stage, attempt) in the shared folder; a task
writes one file per batch of prompts as soon as the batch is answered (under a hidden name
first, then renamed, so a reader never sees half a file). At the start of a round the
journal is read and the rows whose (idiom_id, fingerprint) it holds are not asked again
(an anti join); a changed prompt has another fingerprint and is asked anew, as is a new
row. A batch that a lost task had committed twice is read once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

Answer = tuple[str | None, int | None, int | None]

JOURNAL_SCHEMA = pa.schema([("idiom_id", pa.int64()), ("_fingerprint", pa.string()), ("response", pa.string()),
                            ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("error", pa.string())])
_SPARK_SCHEMA = ("idiom_id long, _fingerprint string, response string, prompt_tokens long, "
                 "completion_tokens long, error string")


def fingerprint(stage: str, attempt: int, prompt: Column) -> Column:
    """What decides whether a stored reply answers a row: stage, attempt and prompt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(stage), F.lit(str(attempt)), F.coalesce(prompt, F.lit("\x00"))), 256)


def _file_system(folder: str):
    """pyarrow's file system of a folder and the path within it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _asking(build: Callable[[], Callable[[str], Answer]], folder: str, batch_rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = build()
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                part = frame.iloc[start:start + batch_rows]
                answers = []
                for prompt in part["prompt"]:
                    try:
                        text, asked, made = ask(prompt)
                        answers.append((text, asked, made, None))
                    except Exception as error:  # the call failed: an attempt without a reply
                        answers.append((None, None, None, f"{type(error).__name__}: {error}"))
                out = pd.DataFrame({
                    "idiom_id": part["idiom_id"].to_numpy(), "_fingerprint": part["_fingerprint"].to_numpy(),
                    "response": [a[0] for a in answers],
                    "prompt_tokens": pd.array([a[1] for a in answers], "Int64"),
                    "completion_tokens": pd.array([a[2] for a in answers], "Int64"),
                    "error": [a[3] for a in answers]})
                name = uuid.uuid4().hex
                hidden, final = f"{root}/_{name}.parquet", f"{root}/part-{name}.parquet"
                pq.write_table(pa.Table.from_pandas(out, JOURNAL_SCHEMA, preserve_index=False), hidden, filesystem=files)
                files.move(hidden, final)
                yield out
    return run


def read_journal(spark: SparkSession, folder: str) -> DataFrame | None:
    """One reply per (idiom_id, fingerprint) in the journal folder, or None if it has none."""
    try:
        rows = spark.read.schema(_SPARK_SCHEMA).parquet(folder)
    except AnalysisException:
        return None
    answer = F.struct("response", "prompt_tokens", "completion_tokens", "error")
    return rows.groupBy("idiom_id", "_fingerprint").agg(F.max(answer).alias("a")).select(
        "idiom_id", "_fingerprint", "a.*")


@dataclass(frozen=True)
class JournaledGenerator:
    """Ask a model on the executors, `batch_rows` prompts to a committed batch of the journal.

    `build` makes the client once per Spark task; called with a prompt it gives (text,
    prompt tokens, completion tokens), and if it raises an Exception the attempt has the
    error and no reply. Anything else that stops a task (a lost executor, a stopped job)
    loses only the batch under way. `spread` deals the prompts over that many partitions.
    Rows with the same idiom_id and prompt are asked once.
    """

    build: Callable[[], Callable[[str], Answer]]
    journal: str
    batch_rows: int = 64
    spread: int | None = None

    def folder(self, stage: str, attempt: int) -> str:
        return f"{self.journal.rstrip('/')}/stage={stage}/attempt={attempt}"

    def reply(self, prompts: DataFrame, stage: str, attempt: int) -> DataFrame:
        spark, folder = prompts.sparkSession, self.folder(stage, attempt)
        keyed = prompts.withColumn("_fingerprint", fingerprint(stage, attempt, F.col("prompt")))
        wanted = keyed.select("idiom_id", "_fingerprint", "prompt").dropDuplicates(["idiom_id", "_fingerprint"])
        stored = read_journal(spark, folder)
        missing = wanted if stored is None else wanted.join(
            stored.select("idiom_id", "_fingerprint"), ["idiom_id", "_fingerprint"], "left_anti")
        if self.spread:
            missing = missing.repartition(self.spread)
        asked = missing.mapInPandas(_asking(self.build, folder, self.batch_rows), _SPARK_SCHEMA)
        asked.write.format("noop").mode("overwrite").save()  # every batch is now in the journal
        replies = read_journal(spark, folder)
        if replies is None:  # nothing was asked: no rows
            replies = spark.createDataFrame([], _SPARK_SCHEMA)
        return keyed.join(replies, ["idiom_id", "_fingerprint"], "left").drop("_fingerprint")
