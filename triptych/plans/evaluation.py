"""The scoring jobs: triples in, score table and report out."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.text import exact
from triptych.operators.report import ReportKind, report_json
from triptych.operators.scoring import (
    BatchScorer,
    Scorer,
    attach_scores,
    error_column,
    fail_whole_calls,
    failed_column,
    score_triples,
)
from triptych.operators.stats import first_score_is_zero, summarize
from triptych.sources.profiles import PROFILES, Labels, Profile
from triptych.sources.shared import materialize
from triptych.sources.writers import output_path, write_report, write_results


@dataclass(frozen=True)
class Evaluation:
    """A scored table and what is reported of it; nothing is computed until used.

    `keyed` has the keys and scores alone, if they are written down already.
    """

    scored: DataFrame
    kind: ReportKind
    language: str
    labels: Labels
    details: Mapping[str, str]
    folder: str
    keyed: DataFrame | None = None

    @property
    def summary(self) -> DataFrame:
        return self._summarize(self.scored if self.keyed is None else self.keyed)

    @property
    def report(self) -> DataFrame:
        return self._report(self.summary)

    def _summarize(self, scored: DataFrame) -> DataFrame:
        kind = self.kind
        return summarize(scored, kind.higher_is_better, kind.nan, kind.tasks, kind.pairs)

    def _report(self, summary: DataFrame) -> DataFrame:
        return report_json(summary, self.kind, self.labels, self.language, **self.details)

    def _names(self) -> dict[str, str]:
        """The reported name of each score column there is."""
        return {t.label: self.kind.column_name(t, self.labels)
                for t in self.kind.tasks if t.label in self.scored.columns}

    def results(self) -> DataFrame:
        """Original columns and score columns under their reported names."""
        names = self._names()
        if "original" in self.scored.columns:
            fields = self.scored.schema["original"].dataType.fieldNames()
            own = [self.scored["original"].getField(f).alias(f) for f in fields]
        else:
            own = [exact(c) for c in self.scored.columns
                   if c not in names and not c.startswith(("failed_", "error_"))]
        return self.scored.select(*own, *(F.col(c).alias(name) for c, name in names.items()))

    def write(self, root: str, file_format: str = "parquet") -> None:
        """Results and report under <root>/<kind>/<language folder>.

        The texts are written once. The report is made from scores that are
        written down already, or from the score columns of the written results.
        Delimited text does not tell NaN from NULL, so for it there is a typed
        copy of keys and scores, or else of the results, in between.
        """
        path = output_path(root, self.kind.name, self.folder)
        results = self.results()
        if self.keyed is not None:
            write_results(results, f"{path}/results", file_format)
            return write_report(self.report, f"{path}/report")
        if file_format == "csv":
            stored = materialize(results, "results")
            write_results(stored, f"{path}/results", file_format)
        else:
            write_results(results, f"{path}/results", file_format)
            stored = (self.scored.sparkSession.read.schema(results.schema)
                      .format(file_format).load(f"{path}/results"))
        scores = stored.select(*(exact(name).alias(c)
                                 for c, name in self._names().items()))
        return write_report(self._report(self._summarize(scores)), f"{path}/report")


def _scored_keys(triples: DataFrame, kind: ReportKind, scorer: BatchScorer, keys: Sequence[str],
                 call_group: str | None, spread: int | None, codes: tuple[Column, Column],
                 whole_calls: bool) -> tuple[DataFrame, BatchScorer]:
    """Keys and scores of a batch scorer, written down; the scorer with its policy.

    The texts stay where they are: what is written has the keys, scores, flags
    and errors.
    """
    scorer = replace(scorer, on_failure=scorer.on_failure or kind.on_failure)
    scored = score_triples(triples, scorer, kind.tasks, call_group, spread, codes, by_row=not whole_calls)
    extra = [call_group] if call_group and call_group not in keys else []
    own = [c(t.label) for t in kind.tasks for c in (str, failed_column, error_column)]
    scored = materialize(scored.select(*keys, *extra, *own), "scored")
    if not scored.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} must be unique among the triples")
    if whole_calls:
        scored = fail_whole_calls(scored, scorer, kind.tasks, call_group)
    return scored.drop(*extra), scorer


def _lost(scored: DataFrame, kind: ReportKind, scorer: BatchScorer, by: Sequence[str] = ()) -> dict[tuple, list[str]]:
    """Per group, the tasks without a score because all their calls failed; each with a warning.

    Zero scores are scores. Groups are languages.
    """
    if scorer.on_failure == "zero":
        return {}
    found = scored.groupBy(*by).agg(F.count("*").alias("_rows"), *(
        F.count_if(failed_column(t.label)).alias(failed_column(t.label)) for t in kind.tasks), *(
        F.min(error_column(t.label)).alias(error_column(t.label)) for t in kind.tasks)).collect()
    lost: dict[tuple, list[str]] = {}
    for row in found:
        gone = [t.label for t in kind.tasks if row["_rows"] and row[failed_column(t.label)] == row["_rows"]]
        lost[tuple(row[c] for c in by)] = gone
        for label in gone:
            warnings.warn(f"{label}{''.join(f' of {row[c]}' for c in by)} failed and is left out: "
                          f"{row[error_column(label)]}", stacklevel=3)
    return lost


def _warn_of_zero(scored: DataFrame, kind: ReportKind, by: Sequence[str] = ()) -> None:
    if kind.first_zero_warns:
        for row in first_score_is_zero(scored, kind.tasks[0].label, by=by).collect():
            if row["first_score_is_zero"]:
                warnings.warn(f"the first score{''.join(f' of {row[c]}' for c in by)} is 0: did the calls fail?",
                              stacklevel=3)


def _codes(scorer: Scorer, profiles: Mapping[str, Profile], language: str | Column) -> tuple[Column, Column]:
    """Columns of source and target code; scorers that take frames have their own target codes."""
    def target(profile: Profile) -> str:
        return profile.pair_code if getattr(scorer, "takes", "") == "frame" else profile.code

    if isinstance(language, str):
        return F.lit(profiles[language].source_code), F.lit(target(profiles[language]))
    sources, targets = (F.create_map(*(F.lit(x) for name, p in profiles.items() for x in (name, code(p))))
                        for code in (lambda p: p.source_code, target))
    return F.element_at(sources, language), F.element_at(targets, language)


def evaluate(triples: DataFrame, kind: ReportKind, language: str, scorer: Scorer | None = None,
             scores: DataFrame | None = None, corrected_labels: bool = False,
             spread: int | None = None, call_group: str | None = None, whole_calls: bool = True,
             profiles: Mapping[str, Profile] = PROFILES, **details: str) -> Evaluation:
    """Score triples and report on them.

    Give a scorer, or the long scores of an outside one (seg_id, task, score).
    A batch scorer's scores are written down first, with their keys, as they may
    be used more than once; seg_id must be unique.

    One failed call voids its task for all rows of its `call_group`, or for all
    rows, as if they were scored in one call. Without `whole_calls` a failed
    call is repeated text by text, and only rows that fail alone are marked.
    Neither depends on how the rows lie in partitions. What is left of a failure
    is the scorer's policy or, if it has none, that of the report: judges give
    zero, calibrated scorers stop the job, distances leave the task out. A task
    without any score is left out with its averages and pairs, and a warning.
    """
    if (scorer is None) == (scores is None):
        raise ValueError("give either a scorer or scores")
    profile, keyed = profiles[language], None
    if scorer is None:
        scored = attach_scores(triples, scores, kind.tasks)
    else:
        if scorer.higher_is_better != kind.higher_is_better:
            raise ValueError(f"{scorer.name} does not sort the way {kind.name} reports do")
        if isinstance(scorer, BatchScorer):
            keyed, scorer = _scored_keys(triples, kind, scorer, ["seg_id"], call_group, spread,
                                         _codes(scorer, profiles, language), whole_calls)
            keyed = keyed.drop(*_lost(keyed, kind, scorer).get((), []))
            _warn_of_zero(keyed, kind)
            scored = triples.join(keyed, "seg_id")
        else:
            scored = score_triples(triples, scorer, kind.tasks, call_group, spread)
    labels = profile.corrected_labels if corrected_labels else profile.labels
    return Evaluation(scored, kind, language, labels, details, profile.folder, keyed)


def evaluate_languages(triples: DataFrame, kind: ReportKind, scorer: Scorer,
                       languages: Sequence[str] | None = None, corrected_labels: bool = False,
                       spread: int | None = None, whole_calls: bool = True,
                       profiles: Mapping[str, Profile] = PROFILES,
                       **details: str) -> tuple[DataFrame, DataFrame]:
    """Score triples of several languages (column `language`) in one job.

    Gives the scored triples and one report per language (language, report). No
    model call mixes languages, and each gets the codes of its language. Failures
    count per language, else as in `evaluate`; language and seg_id are unique.
    """
    lost: dict[tuple, list[str]] = {}
    if isinstance(scorer, BatchScorer):
        keyed, scorer = _scored_keys(triples, kind, scorer, ["language", "seg_id"], "language", spread,
                                     _codes(scorer, profiles, F.col("language")), whole_calls)
        lost = _lost(keyed, kind, scorer, ["language"])
        _warn_of_zero(keyed, kind, ["language"])
        scored = triples.join(keyed, ["language", "seg_id"])
    else:
        keyed = scored = score_triples(triples, scorer, kind.tasks, "language", spread)
    summary = materialize(summarize(keyed, kind.higher_is_better, kind.nan, kind.tasks, kind.pairs,
                                    by=["language"]), "summary")
    reports = []
    for language in languages or list(profiles):
        profile = profiles[language]
        labels = profile.corrected_labels if corrected_labels else profile.labels
        gone = lost.get((language,), [])
        own = summary.filter(F.col("language") == language).drop(
            *(f"mean_{x}" for x in gone), *(f"win_{p.name}" for p in kind.pairs if {p.left, p.right} & set(gone)))
        reports.append(report_json(own, kind, labels, language, **details)
                       .select(F.lit(language).alias("language"), "report"))
    return scored, reduce(DataFrame.unionByName, reports)


def write_reports(reports: DataFrame, root: str, kind: ReportKind,
                  profiles: Mapping[str, Profile] = PROFILES) -> None:
    """The reports of `evaluate_languages`, each under <root>/<kind>/<language folder>."""
    for row in reports.select("language").collect():
        own = reports.filter(F.col("language") == row["language"])
        write_report(own, f"{output_path(root, kind.name, profiles[row['language']].folder)}/report")
