"""Generation stages: prompts in, usable replies out, with bounded retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from triptych.functions.replies import field
from triptych.functions.text import strip, truthy
from triptych.operators.attempts import MAX_ATTEMPTS, parse_attempts
from triptych.sources.shared import is_complete

URDU_KEYS = tuple(f"target_{c}_{script}" for script in ("native", "roman") for c in "ABC")


@dataclass(frozen=True)
class Stage:
    """The fields wanted from a reply, and the keys without which it is retried."""

    name: str
    fields: tuple[str, ...]
    required: tuple[str, ...] = ()


GERMAN = Stage("german", ("english_sentence", "target_A", "target_B", "target_C"),
               required=("english_sentence",))
IDENTIFICATION = Stage("urdu_ident", ("urdu_idiom_native", "urdu_idiom_roman"))
URDU = Stage("urdu_trans", URDU_KEYS)
TRANSLITERATION = Stage("transliteration", ("urdu_idiom_native",))

Answer = tuple[str | None, int | None, int | None]
Ask = Callable[[str], Answer]
AskMany = Callable[[list[str]], list[Answer | Exception]]


class Generator(Protocol):
    def reply(self, prompts: DataFrame, stage: str, attempt: int) -> DataFrame:
        """Add response, prompt_tokens and completion_tokens to the rows, and error if there is one to tell.

        Every row stays, once; it has idiom_id and prompt among its columns.
        """
        ...


@dataclass(frozen=True)
class ModelGenerator:
    """Ask a model, in batches on the executors.

    `build` makes the client, once per Spark task; called with a prompt it
    gives (text, prompt tokens, completion tokens). If it raises, the attempt
    has no reply and no tokens, but the error. With `prompts_per_call` the
    client gets lists of so many prompts at most, and gives a list with such an
    answer, or an exception, for each: for engines that work on batches and
    clients that have many calls under way. If it raises, its prompts are
    asked one by one. `spread` deals the prompts out over that many partitions.
    """

    build: Callable[[], Ask | AskMany]
    spread: int | None = None
    prompts_per_call: int | None = None

    def reply(self, prompts: DataFrame, stage: str, attempt: int) -> DataFrame:
        build, size = self.build, self.prompts_per_call

        def failed(error: Exception) -> tuple:
            return None, None, None, f"{type(error).__name__}: {error}"

        def answers(ask: Callable, some: list[str]) -> list[tuple]:
            try:
                found = ask(some) if size else [ask(some[0])]
                if len(found) != len(some):
                    raise ValueError(f"{len(found)} answers for {len(some)} prompts")
            except Exception as error:
                if len(some) > 1:
                    return [answer for prompt in some for answer in answers(ask, [prompt])]
                return [failed(error)]
            return [failed(x) if isinstance(x, Exception) else (*x, None) for x in found]

        def ask_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            ask = build()
            for batch in batches:
                texts = list(batch)
                rows = [row for i in range(0, len(texts), size or 1) for row in answers(ask, texts[i:i + (size or 1)])]
                yield pd.DataFrame(rows, columns=["response", "prompt_tokens", "completion_tokens", "error"],
                                   dtype=object)

        # Only the prompts go to Python; the other columns stay in the JVM.
        ask_all.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        answered = F.pandas_udf(
            ask_all, "response string, prompt_tokens long, completion_tokens long, error string")
        if self.spread:
            prompts = prompts.repartition(self.spread)
        return (prompts.withColumn("_answer", answered.asNondeterministic()(F.col("prompt")))
                .select(*prompts.columns, "_answer.*"))


@dataclass(frozen=True)
class ReplayGenerator:
    """Replies that were recorded in an attempts table.

    Of an attempt recorded twice one reply is taken, an answer before a failure.
    """

    attempts: DataFrame

    def reply(self, prompts: DataFrame, stage: str, attempt: int) -> DataFrame:
        answer = F.struct("response", "prompt_tokens", "completion_tokens")
        recorded = (self.attempts
                    .filter((F.col("stage") == stage) & (F.col("attempt") == attempt))
                    .groupBy("idiom_id").agg(F.max(answer).alias("_answer"))
                    .select("idiom_id", "_answer.*"))
        return prompts.join(recorded, "idiom_id", "left")


@dataclass(frozen=True)
class StageResult:
    """What a stage made of its prompts.

    `attempts` holds every attempt made, with its error if the call failed. `settled` has each prompt's row once,
    with the fields of its usable reply, or NULL fields if there was none.
    `replies` has only the rows with a usable reply, `rejected` the other ids.
    """

    attempts: DataFrame
    settled: DataFrame
    replies: DataFrame
    rejected: DataFrame


def _asked_alike(stored: DataFrame, pending: DataFrame) -> bool:
    """Whether a stored round asked the same (idiom_id, prompt) rows, as many times each."""
    def rows(frame: DataFrame) -> DataFrame:
        return frame.select("idiom_id", F.sha2(F.coalesce("prompt", F.lit("\x00")), 256).alias("p"))
    return rows(stored).exceptAll(rows(pending)).isEmpty() and rows(pending).exceptAll(rows(stored)).isEmpty()


def run_stage(stage: Stage, prompts: DataFrame, generator: Generator, store: str,
              max_attempts: int = MAX_ATTEMPTS, resume: bool = False) -> StageResult:
    """Ask for every prompt until its reply is usable, `max_attempts` times at most.

    `prompts` has idiom_id, prompt and any columns to keep with them. Each
    round is written under `store` before the next one starts, and the next
    one reads what is left from it, so no paid call is made twice because of a
    lost executor, and nothing has to be joined back. A store belongs to one
    run. With `resume`, rounds that are already complete there are taken as
    they are if they asked the same ids with the same prompts; an incomplete one,
    or one that asked other rows, is written anew (a `JournaledGenerator` then pays
    only for the rows its journal lacks). Usable and other replies
    of a round lie apart, so each reader reads its own.
    """
    spark = prompts.sparkSession
    kept = [c for c in prompts.columns if c not in ("idiom_id", "prompt")]
    asked = ["idiom_id", "prompt"]
    pending = prompts.select(*asked)
    if kept:
        asked.append("kept")
        pending = prompts.select("idiom_id", "prompt", F.struct(*kept).alias("kept"))
    rounds: list[DataFrame] = []
    left = 0
    for attempt in range(1, max_attempts + 1):
        path = f"{store}/{stage.name}/attempt={attempt}"
        replied = generator.reply(pending, stage.name, attempt)
        error = F.col("error") if "error" in replied.columns else F.lit(None).cast("string")
        made = parse_attempts(replied.select(
            F.lit(stage.name).alias("stage"), F.lit(attempt).alias("attempt"), *asked,
            strip(F.col("response")).alias("response"), "prompt_tokens", "completion_tokens", error.alias("error")),
            stage.required).withColumn("usable", F.col("reply").isNotNull())
        made = made.select(*(c for c in made.columns if c != "usable"), "usable")
        if resume and is_complete(spark, path) and _asked_alike(
                spark.read.schema(made.schema).parquet(path), pending):
            left = None
        else:
            seen = Observation()
            observed = made.observe(seen, F.count_if(~F.col("usable")).alias("left"))
            observed.write.partitionBy("usable").mode("overwrite" if resume else "error").parquet(path)
            left = seen.get["left"]
        rounds.append(spark.read.schema(made.schema).parquet(path))
        pending = rounds[-1].filter(~F.col("usable")).select(*asked)
        if left == 0 or left is None and pending.isEmpty():
            break
    attempts = reduce(DataFrame.unionByName, rounds)
    answered = F.col("usable")
    fields = [field(F.col("reply"), f).alias(f) for f in stage.fields]
    row = ["idiom_id", *(F.col(f"kept.`{c}`") for c in kept), *fields]
    return StageResult(attempts.drop("usable"),
                       attempts.filter(answered | (F.col("attempt") == max_attempts)).select(*row),
                       attempts.filter(answered).select(*row),
                       pending.select("idiom_id"))


def attach_german(base: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows without a usable German reply are dropped."""
    return base.join(replies.select("idiom_id", *GERMAN.fields), "idiom_id")


def attach_identification(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows without an Urdu idiom stay, with NULL."""
    return rows.join(replies.select("idiom_id", *IDENTIFICATION.fields), "idiom_id", "left")


def has_both_idioms() -> Column:
    """Whether Urdu translations are asked for; never NULL."""
    return truthy(F.col("urdu_idiom_native")) & truthy(F.col("urdu_idiom_roman"))


def attach_urdu(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Urdu translations, only where both Urdu idioms are there."""
    fields = replies.select(F.col("idiom_id").alias("_id"), *URDU.fields)
    return (rows.join(fields, (F.col("idiom_id") == F.col("_id")) & has_both_idioms(), "left")
            .drop("_id"))


def wide_dataset(rows: DataFrame) -> DataFrame:
    """The 16 named columns of the finished table."""
    # The column names of the finished table.
    names = {
        "Idiom ID": "idiom_id",
        "English Idiom": "idiom",
        "Meaning": "meaning",
        "English Sentence": "english_sentence",
        "German Idiom Match": "german_idiom",
        "German Target A (Figurative)": "target_A",
        "German Target B (Alternative)": "target_B",
        "German Target C (Literal Incorrect)": "target_C",
        "Urdu Native Idiom": "urdu_idiom_native",
        "Urdu Roman Idiom": "urdu_idiom_roman",
        "Urdu Native Target A (Idiomatic)": "target_A_native",
        "Urdu Native Target B (Descriptive)": "target_B_native",
        "Urdu Native Target C (Literal)": "target_C_native",
        "Urdu Roman Target A (Idiomatic)": "target_A_roman",
        "Urdu Roman Target B (Descriptive)": "target_B_roman",
        "Urdu Roman Target C (Literal)": "target_C_roman",
    }
    return rows.select(*(F.col(column).alias(name) for name, column in names.items()))


def assemble(base: DataFrame, german: DataFrame, identification: DataFrame,
             urdu: DataFrame) -> DataFrame:
    """Base idioms with the replies of all three stages, as the finished table.

    All joins are on idiom_id, so each side is shuffled once at most.
    """
    named = attach_identification(attach_german(base, german), identification)
    return wide_dataset(attach_urdu(named, urdu))
