"""Reports: averages and win rates under the names of each kind of metric."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.operators.scoring import error_column, failed_column
from triptych.operators.stats import QE_PAIRS, Pair
from triptych.operators.tasks import NINE_TASKS, QE_TASKS, Task
from triptych.sources.profiles import Labels


@dataclass(frozen=True)
class ReportKind:
    """What a kind of metric reports, and how it is named.

    The patterns take {hyp}, {ref} and {label} for averages and score columns,
    {left} and {right} for win rates. `on_failure` is what a failed call of a
    batch scorer leaves, `first_zero_warns` whether a first score of 0 is a sign of failure.
    """

    name: str
    higher_is_better: bool
    nan: str
    tasks: tuple[Task, ...]
    average_tasks: tuple[Task, ...]
    average_name: str
    reference_average_name: str
    qe_column_name: str
    reference_column_name: str
    pairs: tuple[Pair, ...]
    pair_name: str
    on_failure: str
    single_rate: bool = False
    first_zero_warns: bool = False

    def average_key(self, task: Task, labels: Labels) -> str:
        pattern = self.average_name if task.reference_free else self.reference_average_name
        return pattern.format(hyp=task.hyp, ref=task.ref, label=labels[task.hyp])

    def column_name(self, task: Task, labels: Labels) -> str:
        pattern = self.qe_column_name if task.reference_free else self.reference_column_name
        return pattern.format(hyp=task.hyp, ref=task.ref, label=labels[task.hyp])

    def pair_key(self, pair: Pair) -> str:
        return self.pair_name.format(left=pair.name[0], right=pair.name[1])


# The key and column patterns of the three kinds.
JUDGE = ReportKind(
    "judge", True, "propagate", QE_TASKS, QE_TASKS,
    average_name="{hyp}_{label}", reference_average_name="",
    qe_column_name="Score_{hyp}_{label}", reference_column_name="",
    pairs=QE_PAIRS[:1], pair_name="win_rate_{left}_vs_{right}", on_failure="zero", single_rate=True,
    first_zero_warns=True)
CALIBRATED = ReportKind(
    "calibrated", True, "propagate", NINE_TASKS, QE_TASKS,
    average_name="QE_{hyp}_{label}", reference_average_name="",
    qe_column_name="Score_QE_{hyp}_{label}", reference_column_name="Score_{hyp}_ref_{ref}",
    pairs=QE_PAIRS, pair_name="{left}_vs_{right}", on_failure="fail")
DISTANCE = ReportKind(
    "distance", False, "skip", NINE_TASKS, NINE_TASKS,
    average_name="Score_QE_{hyp}", reference_average_name="Score_{hyp}_Ref_{ref}",
    qe_column_name="Score_QE_{hyp}", reference_column_name="Score_{hyp}_Ref_{ref}",
    pairs=QE_PAIRS, pair_name="{left}_beats_{right}", on_failure="omit")

KINDS = (JUDGE, CALIBRATED, DISTANCE)


def lower_is_better_note(metric: str) -> str:
    return f"{metric} scores are Lower-is-Better"


def _entries(summary: DataFrame, kind: ReportKind, labels: Labels) -> tuple[
        list[tuple[str, Column]], list[tuple[str, Column]]]:
    """The averages and the win rates that the summary has."""
    means = [(kind.average_key(t, labels), F.col(f"mean_{t.label}"))
             for t in kind.average_tasks if f"mean_{t.label}" in summary.columns]
    rates = [(kind.pair_key(p), F.col(f"win_{p.name}"))
             for p in kind.pairs if f"win_{p.name}" in summary.columns]
    return means, rates


def report_long(summary: DataFrame, kind: ReportKind, labels: Labels,
                by: Sequence[str] = ()) -> DataFrame:
    """A summary as rows: by, section, key, value; section `failed` counts rows of failed calls."""
    means, rates = _entries(summary, kind, labels)
    failed = [(t.label, F.col(failed_column(t.label))) for t in kind.tasks
              if failed_column(t.label) in summary.columns]
    rows = F.array(*(
        F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"),
                 value.cast("double").alias("value"))
        for section, entries in (("averages", means), ("win_rates", rates), ("failed", failed))
        for key, value in entries))
    return summary.select(*by, F.explode(rows).alias("_row")).select(*by, "_row.*")


def report_json(summary: DataFrame, kind: ReportKind, labels: Labels, language: str | Column,
                **details: str) -> DataFrame:
    """One indented JSON text per summary row.

    `details` are further texts at the top, such as model, method or note. If
    calls failed, `failed` has the number of their rows and `errors` one error, per task.
    """
    means, rates = _entries(summary, kind, labels)

    def as_map(entries: list[tuple[str, Column]]) -> Column:
        if not entries:
            return F.create_map().cast("map<string,double>")
        return F.create_map(*(x for key, value in entries for x in (F.lit(key), value)))

    language = F.lit(language) if isinstance(language, str) else language
    parts = [language.alias("language"), *(F.lit(v).alias(k) for k, v in details.items())]
    averages = as_map(means).alias("averages")
    if kind.single_rate:
        parts += [averages, *(value.alias(key) for key, value in rates)]
    elif kind.higher_is_better:
        parts += [averages, as_map(rates).alias("win_rates")]
    else:
        parts += [as_map(rates).alias("win_rates"), averages]
    for name, column in (("failed", failed_column), ("errors", error_column)):
        found = [(F.lit(t.label), F.col(column(t.label))) for t in kind.tasks if column(t.label) in summary.columns]
        if found:
            bad = F.map_filter(F.create_map(*(x for pair in found for x in pair)),
                               lambda _, v: v.isNotNull() & (v.cast("string") != "0"))
            parts.append(F.when(F.size(bad) > 0, bad).alias(name))
    return summary.select(F.to_json(F.struct(*parts), {"pretty": "true"}).alias("report"))
