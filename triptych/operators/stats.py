"""Averages and win rates over scored triples, in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.operators.scoring import error_column, failed_column
from triptych.operators.tasks import QE_TASKS, Task


@dataclass(frozen=True)
class Pair:
    """How often the candidate of task `left` beats that of task `right`."""

    name: str
    left: str
    right: str


QE_PAIRS = tuple(Pair(a + b, f"Score_QE_{a}", f"Score_QE_{b}") for a, b in ("AB", "AC", "BC"))


def beats(left: Column, right: Column, higher_is_better: bool) -> Column:
    """Strictly better, and neither score NaN; NULL if one is NULL."""
    better = left > right if higher_is_better else left < right
    return better & ~F.isnan(left) & ~F.isnan(right)


def win_rate(left: Column, right: Column, higher_is_better: bool) -> Column:
    """Share of all rows, NaN, NULL and ties included, that `left` wins."""
    return F.try_divide(F.count_if(beats(left, right, higher_is_better)), F.count("*"))


def mean(score: Column, nan: str) -> Column:
    """`propagate`: one NaN makes the mean NaN. `skip`: NaN is left out."""
    if nan == "propagate":
        return F.avg(score)
    if nan == "skip":
        return F.avg(F.nanvl(score, F.lit(None).cast("double")))
    raise ValueError(f"nan is 'propagate' or 'skip', not {nan!r}")


def summarize(scored: DataFrame, higher_is_better: bool, nan: str = "propagate",
              tasks: Sequence[Task] = QE_TASKS, pairs: Sequence[Pair] = QE_PAIRS,
              by: Sequence[str] = ()) -> DataFrame:
    """Per group of `by`: n_rows, mean_<task>, win_<pair>, failed_<task>, error_<task>.

    The last two are the number of rows of failed calls and one of their errors.
    Tasks without a score column, and pairs with such a task, are left out.
    All measures combine before the shuffle, so a large group does no harm.
    """
    have = set(scored.columns)
    measures = [F.count("*").alias("n_rows")]
    measures += [mean(F.col(t.label), nan).alias(f"mean_{t.label}")
                 for t in tasks if t.label in have]
    measures += [win_rate(F.col(p.left), F.col(p.right), higher_is_better).alias(f"win_{p.name}")
                 for p in pairs if {p.left, p.right} <= have]
    measures += [F.count_if(failed_column(t.label)).alias(failed_column(t.label))
                 for t in tasks if failed_column(t.label) in have]
    measures += [F.min(error_column(t.label)).alias(error_column(t.label))
                 for t in tasks if error_column(t.label) in have]
    return scored.groupBy(*by).agg(*measures)


def averages(scored: DataFrame, nan: str, tasks: Sequence[Task] = QE_TASKS,
             by: Sequence[str] = ()) -> DataFrame:
    """The means as rows: by, task, average."""
    return _as_rows(summarize(scored, True, nan, tasks, (), by), by, "mean_", "task", "average")


def win_rates(scored: DataFrame, higher_is_better: bool, pairs: Sequence[Pair] = QE_PAIRS,
              by: Sequence[str] = ()) -> DataFrame:
    """The win rates as rows: by, pair, win_rate."""
    return _as_rows(summarize(scored, higher_is_better, tasks=(), pairs=pairs, by=by),
                    by, "win_", "pair", "win_rate")


def _as_rows(summary: DataFrame, by: Sequence[str], prefix: str, name: str, value: str) -> DataFrame:
    columns = [c for c in summary.columns if c.startswith(prefix) and c not in by]
    named = summary.select(*by, *(F.col(c).alias(c.removeprefix(prefix)) for c in columns))
    return named.unpivot(list(by), [c.removeprefix(prefix) for c in columns], name, value)


def first_score_is_zero(scored: DataFrame, label: str = "Score_QE_A", key: str = "seg_id",
                        by: Sequence[str] = ()) -> DataFrame:
    """Per group of `by`: whether the first segment has score 0, a sign of a failed run."""
    return scored.groupBy(*by).agg((F.min_by(label, key) == 0.0).alias("first_score_is_zero"))
