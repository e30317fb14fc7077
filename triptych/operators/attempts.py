"""Model attempts: first usable reply, tokens and costs.

An attempts table has stage, idiom_id, attempt (from 1), response,
prompt_tokens and completion_tokens; response and tokens are NULL when the
call failed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.functions.replies import field, usable, with_object
from triptych.functions.text import strip

MAX_ATTEMPTS = 3

# Dollars per thousand tokens, placeholders to be adjusted.
INPUT_RATE, OUTPUT_RATE = 0.01, 0.1


def parse_attempts(attempts: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Add `reply`, the usable object of the response, else NULL."""
    parsed = with_object(attempts, strip(F.col("response")), "_object")
    return (parsed.withColumn("reply", F.when(usable(F.col("_object"), required), F.col("_object")))
            .drop("_object"))


def first_valid(attempts: DataFrame, keys: Sequence[str], fields: Sequence[str],
                required: tuple[str, ...] = (), max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per key the first usable reply: keys, attempt and `fields` of the object.

    The smallest (attempt, fields) combines before the shuffle, so any number
    of rows per key is fine, and only the fields travel.
    """
    parsed = parse_attempts(attempts.filter(F.col("attempt") <= max_attempts), required)
    candidate = F.struct(F.col("attempt"), *(field(F.col("reply"), f).alias(f) for f in fields))
    # The filter is an aggregate's: a row filter would have the reply parsed twice.
    best = parsed.groupBy(*keys).agg(
        F.min(F.when(F.col("reply").isNotNull(), candidate)).alias("_best"))
    return best.filter(F.col("_best").isNotNull()).select(*keys, "_best.*")


def tokens_made(attempts: DataFrame, keys: Sequence[str] = ("stage", "idiom_id"),
                required: tuple[str, ...] = (), max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per key the tokens of the attempts a run makes of a replay table.

    These are the attempts up to the first usable one, `max_attempts` at most.
    A few sums and flags per key and attempt number are enough for that.
    """
    parsed = parse_attempts(attempts.filter(F.col("attempt") <= max_attempts), required)
    measures = []
    for n in range(1, max_attempts + 1):
        here = F.col("attempt") == n
        measures += [
            F.coalesce(F.bool_or(here & F.col("reply").isNotNull()), F.lit(False)).alias(f"_ok{n}"),
            F.count_if(here).alias(f"_n{n}"),
            F.coalesce(F.sum(F.when(here, F.col("prompt_tokens"))), F.lit(0)).alias(f"_in{n}"),
            F.coalesce(F.sum(F.when(here, F.col("completion_tokens"))), F.lit(0)).alias(f"_out{n}")]
    made = {"_n": F.lit(0), "_in": F.lit(0), "_out": F.lit(0)}
    for n in range(max_attempts, 0, -1):
        made = {m: F.col(f"{m}{n}") + F.when(F.col(f"_ok{n}"), F.lit(0)).otherwise(later)
                for m, later in made.items()}
    return parsed.groupBy(*keys).agg(*measures).select(
        *keys, made["_n"].alias("attempts"), made["_in"].alias("prompt_tokens"),
        made["_out"].alias("completion_tokens"))


def token_sums(made: DataFrame) -> DataFrame:
    """Tokens per stage of attempts that were made; calls without usage count 0."""
    return made.groupBy("stage").agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))


def cost_summary(made: DataFrame, input_rate: float = INPUT_RATE,
                 output_rate: float = OUTPUT_RATE, total: str = "total") -> DataFrame:
    """Tokens and cost per stage, and a row for all stages together."""
    sums = token_sums(made)
    rolled = sums.rollup("stage").agg(F.sum("prompt_tokens").alias("prompt_tokens"),
                                      F.sum("completion_tokens").alias("completion_tokens"),
                                      F.grouping("stage").alias("_all"))
    cost = (F.col("prompt_tokens") / 1000 * input_rate
            + F.col("completion_tokens") / 1000 * output_rate)
    return (rolled.filter((F.col("_all") == 0) | F.col("prompt_tokens").isNotNull())
            .select(F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col("stage")).alias("stage"),
                    "prompt_tokens", "completion_tokens", cost.alias("cost")))
