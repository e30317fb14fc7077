"""Scores for triples: column scorers, batch scorers and scores from files."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.text import exact
from triptych.operators.tasks import CANDIDATE, NINE_TASKS, Task
from triptych.sources.shared import materialize

Texts = Sequence[str]
Model = Callable[..., Sequence[float]]
# Texts that become Python's at a time.
CALL_BYTES = 8 << 20
INPUTS = ("texts", "codes", "frame")
POLICIES = ("zero", "null", "omit", "fail")


class Codes(NamedTuple):
    """What a scorer calls the languages of a call."""

    source: str
    target: str


@dataclass(frozen=True)
class ColumnScorer:
    """A scorer made of Spark columns.

    `prepare` is applied once to each text. `compare` gives the score of a
    prepared hypothesis, from it and the prepared text it is judged against.
    With `shared`, a measure that two prepared texts have in common whichever
    way round, `compare` gets that instead, and it is computed once per pair.
    """

    name: str
    higher_is_better: bool
    prepare: Callable[[Column], Column]
    compare: Callable[[Column, Column], Column]
    shared: Callable[[Column, Column], Column] | None = None


@dataclass(frozen=True)
class BatchScorer:
    """A scorer that runs a model on lists of texts.

    `build` makes the model, once per Spark task. `takes` says what a call gets:

    * `texts`: sources, hypotheses and references (None when reference-free),
    * `codes`: the same and the Codes of source and target language,
    * `frame`: one pandas frame with the columns of `scorer_frame`.

    It gives one number per text, NaN or None where it has none. No call mixes
    languages. A row with a missing text is never sent and has no score.

    `cost_per_call` bounds a call by its padded length: rows times the characters of the
    longest row's texts (source, hypothesis and reference together). Rows of like length
    then go together; a row above the bound is sent alone. Without it calls have
    `rows_per_call` rows in the order of the batch.

    `on_failure` says what a failed call leaves: `zero` scores (not for scores
    of which the lowest is best), `null` scores, `omit` to leave the task out
    of the report as well, or `fail` to stop the job. Without it the policy is that of the
    report, or `null`.
    """

    name: str
    higher_is_better: bool
    build: Callable[[], Model]
    rows_per_call: int = 256
    on_failure: str | None = None
    takes: str = "texts"
    cost_per_call: int | None = None

    def __post_init__(self) -> None:
        if self.on_failure not in (None, *POLICIES):
            raise ValueError(f"on_failure is one of {POLICIES}, not {self.on_failure!r}")
        if self.on_failure == "zero" and not self.higher_is_better:
            raise ValueError("zero is the best score there is: a failure must not win")
        if self.takes not in INPUTS:
            raise ValueError(f"takes is one of {INPUTS}, not {self.takes!r}")


Scorer = ColumnScorer | BatchScorer


def failed_column(label: str) -> str:
    return f"failed_{label}"


def error_column(label: str) -> str:
    return f"error_{label}"


def _against(task: Task) -> str:
    return CANDIDATE[task.ref] if task.ref else "src"


def score_triples(triples: DataFrame, scorer: Scorer, tasks: Sequence[Task] = NINE_TASKS,
                  call_group: str | None = None, spread: int | None = None,
                  codes: tuple[Column, Column] | None = None, by_row: bool = False) -> DataFrame:
    """Add one score column per task, in one pass and without a shuffle.

    A batch scorer also adds a `failed_` flag and an `error_` text per task; its
    result has to be materialized before it is used twice. One model call never
    mixes two values of `call_group` or of `codes`, the columns of source and
    target code. All rows of a failed call are marked; with `by_row` the call is
    repeated text by text, so that only those are which fail alone. `spread`
    deals the rows out over that many partitions first: for a slow model and
    input that lies in few files.
    """
    if spread:
        triples = triples.repartition(spread)
    if isinstance(scorer, ColumnScorer):
        return _score_by_columns(triples, scorer, tasks)
    if scorer.takes != "texts" and codes is None:
        raise ValueError(f"{scorer.name} takes language codes")
    return _score_by_batches(triples, scorer, tasks, call_group, codes, by_row)


def _score_by_columns(triples: DataFrame, scorer: ColumnScorer, tasks: Sequence[Task]) -> DataFrame:
    sides = [(CANDIDATE[t.hyp], _against(t)) for t in tasks]
    used = sorted({column for side in sides for column in side})
    frame = triples.select("*", *(scorer.prepare(F.col(c)).alias(f"_{c}") for c in used))
    other = {side: f"_{side[1]}" for side in sides}
    if scorer.shared:
        pairs = sorted({tuple(sorted(side)) for side in sides})
        frame = frame.select("*", *(scorer.shared(F.col(f"_{x}"), F.col(f"_{y}")).alias(f"_{x}_{y}")
                                    for x, y in pairs))
        other = {side: "_" + "_".join(sorted(side)) for side in sides}
    scores = [scorer.compare(F.col(f"_{side[0]}"), F.col(other[side])).cast("double").alias(t.label)
              for t, side in zip(tasks, sides, strict=True)]
    return frame.select(*triples.columns, *scores)


def _calls(keys: pd.DataFrame, sent: np.ndarray, rows_per_call: int, cost: np.ndarray | None = None,
           cost_per_call: int | None = None) -> Iterator[np.ndarray]:
    """Positions of the rows of each model call: rows that are sent, with the same keys.

    With `cost_per_call` the rows of a group are taken by rising `cost` (texts of like
    length together) and a call ends before its rows times its largest cost would pass
    the bound, as a padded batch would; a row above the bound is a call of its own. The
    scores go back to the rows by their positions, so the order does not change.
    """
    rows = np.flatnonzero(sent)
    if not len(rows):
        return
    for _, own in keys.iloc[rows].groupby(list(keys.columns), dropna=False, sort=False).indices.items():
        members = rows[own]
        if cost_per_call is None or cost is None:
            for start in range(0, len(members), rows_per_call):
                yield members[start:start + rows_per_call]
            continue
        members = members[np.argsort(cost[members], kind="stable")]
        start = 0
        while start < len(members):
            stop = start + 1
            while (stop < len(members) and stop - start < rows_per_call
                   and (stop - start + 1) * cost[members[stop]] <= cost_per_call):
                stop += 1
            yield members[start:stop]
            start = stop


_SCORED, _FAILED, _NAN, _UNSENT = 0, 1, 2, 3


class _Caller:
    """Calls a model on some rows of a batch for one task."""

    def __init__(self, scorer: BatchScorer, text: dict[str, np.ndarray], keys: pd.DataFrame,
                 segments: np.ndarray, by_row: bool):
        self.scorer, self.text, self.keys, self.segments, self.by_row = scorer, text, keys, segments, by_row
        self.model = scorer.build()

    def arguments(self, task: Task, rows: np.ndarray) -> list[Any]:
        sources, hypotheses = (list(self.text[c][rows]) for c in ("src", CANDIDATE[task.hyp]))
        references = list(self.text[CANDIDATE[task.ref]][rows]) if task.ref else None
        if self.scorer.takes == "texts":
            return [sources, hypotheses, references]
        codes = Codes(*(self.keys[c].iloc[rows[0]] for c in ("source", "target")))
        if self.scorer.takes == "codes":
            return [sources, hypotheses, references, codes]
        return [pd.DataFrame({
            "src": sources, "mt": hypotheses, "ref": references or [""] * len(rows),
            "lp": "-".join(codes), "seg_id": self.segments[rows], "system-name": "sys", "human_ratings": 0.0})]

    def __call__(self, task: Task, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, str | None]]:
        """Rows, their scores, and the error if there was one."""
        try:
            scores = np.array([np.nan if v is None else float(v) for v in self.model(*self.arguments(task, rows))])
            if len(scores) != len(rows):
                raise ValueError(f"{len(scores)} scores for {len(rows)} texts")
            yield rows, scores, None
        except Exception as error:
            if self.scorer.on_failure == "fail":
                raise
            if self.by_row and len(rows) > 1:
                for row in rows:
                    yield from self(task, np.array([row]))
            else:
                yield rows, np.zeros(len(rows)), f"{type(error).__name__}: {error}"


def _few(batches: Iterator[tuple[pa.Array, ...]], rows_per_call: int,
         most: int = CALL_BYTES) -> Iterator[tuple[pd.Series, ...]]:
    """The rows as pandas columns, so many at a time that they have about `most` bytes of text and
    fill whole calls, one call at least: Python texts are several times as large as Arrow's."""
    for columns in batches:
        sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    for c in columns[4:])
        ends, start = np.cumsum(sizes), 0
        while start < len(ends):
            fit = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")) - start
            stop = start + (fit if start + fit == len(ends) else max(fit // rows_per_call, 1) * rows_per_call)
            yield tuple(c.slice(start, stop - start).to_pandas() for c in columns)
            start = stop


def _score_by_batches(triples: DataFrame, scorer: BatchScorer, tasks: Sequence[Task],
                      call_group: str | None, codes: tuple[Column, Column] | None, by_row: bool) -> DataFrame:
    texts = sorted({"src"} | {CANDIDATE[t.hyp] for t in tasks} | {_against(t) for t in tasks})

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        call = None
        for group, source, target, segments, *columns in _few(batches, scorer.rows_per_call):
            text = dict(zip(texts, (c.to_numpy() for c in columns), strict=True))
            keys = pd.DataFrame({"group": group, "source": source, "target": target})
            if call is None:
                call = _Caller(scorer, text, keys, segments.to_numpy(), by_row)
            call.text, call.keys, call.segments = text, keys, segments.to_numpy()
            out: dict[str, Any] = {}
            for task in tasks:
                used = {"src", CANDIDATE[task.hyp], _against(task)}
                sent = np.logical_and.reduce([~pd.isna(text[c]) for c in used])
                scores = np.zeros(len(keys))
                status = np.where(sent, _SCORED, _UNSENT).astype(np.int8)
                errors = np.full(len(keys), None, dtype=object)
                cost = None
                if scorer.cost_per_call is not None:
                    cost = sum(pd.Series(text[c]).fillna("").str.len().to_numpy() for c in used)
                for rows in _calls(keys, sent, scorer.rows_per_call, cost, scorer.cost_per_call):
                    for some, values, error in call(task, rows):
                        scores[some], errors[some] = values, error
                        status[some] = _SCORED if error is None else _FAILED
                status[np.isnan(scores)] = _NAN
                out |= {task.label: scores, failed_column(task.label): status, error_column(task.label): errors}
            yield pa.StructArray.from_arrays([pa.array(v, type=t, from_pandas=False) for v, t in zip(
                out.values(), [pa.float64(), pa.int8(), pa.string()] * len(tasks), strict=True)], list(out))

    # The texts go to Python once for all tasks; the other columns stay in the JVM.
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]],
                           "return": Iterator[pa.Array]}
    schema = ", ".join(f"`{t.label}` double, `{failed_column(t.label)}` byte, `{error_column(t.label)}` string"
                       for t in tasks)
    scored = F.arrow_udf(run, schema).asNondeterministic()
    group = F.col(call_group) if call_group else F.lit(0)
    segment = F.col("seg_id") if "seg_id" in triples.columns else F.lit(0)
    source, target = codes or (F.lit(""), F.lit(""))
    frame = triples.withColumn("_scores", scored(group, source, target, segment, *(F.col(c) for c in texts)))
    # NaN would arrive as NULL, so it comes as a status.
    missing = F.lit(None).cast("double")
    fallback = F.lit(0.0) if scorer.on_failure == "zero" else missing
    columns = []
    for task in tasks:
        score, status, error = (F.col(f"_scores.{c}") for c in (
            task.label, failed_column(task.label), error_column(task.label)))
        columns += [F.when(status == _NAN, F.lit(float("nan"))).when(status == _FAILED, fallback)
                    .when(status == _UNSENT, missing).otherwise(score).alias(task.label),
                    (status == _FAILED).alias(failed_column(task.label)), error.alias(error_column(task.label))]
    return frame.select(*triples.columns, *columns)


def fail_whole_calls(scored: DataFrame, scorer: BatchScorer, tasks: Sequence[Task],
                     call_group: str | None = None) -> DataFrame:
    """Let one failed call void all scores of its task, in its group if there are groups.

    This is what happens when all rows, or all of a group, are scored in a
    single call, however many batches it was in here. `scored` must be
    materialized. Groups are languages or the like; those with a failed call are written
    down, so that Spark knows their size when it joins them.
    """
    labels = [t.label for t in tasks]
    flags = [F.coalesce(F.max(failed_column(x)), F.lit(False)).alias(f"_any_{x}") for x in labels]
    if call_group is None:
        found = scored.agg(*flags).first()
        joined, void = scored, {x: F.lit(found[f"_any_{x}"]) for x in labels}
    else:
        voided = scored.groupBy(call_group).agg(*flags).filter(
            F.array_contains(F.array(*(F.col(f"_any_{x}") for x in labels)), True))
        joined = scored.join(materialize(voided, "voided"), call_group, "left")
        void = {x: F.coalesce(f"_any_{x}", F.lit(False)) for x in labels}
    fallback = F.lit(0.0 if scorer.on_failure == "zero" else None).cast("double")
    changed = {x: F.when(void[x], fallback).otherwise(F.col(x)) for x in labels}
    changed |= {failed_column(x): void[x] | F.col(failed_column(x)) for x in labels}
    return joined.select(*(changed[c].alias(c) if c in changed else exact(c) for c in scored.columns))


def score_pairs(pairs: DataFrame, scorer: ColumnScorer, name: str = "score") -> DataFrame:
    """Add a score to a long frame with src, hyp and ref.

    A row is judged against its source if `is_qe` says so or, without that column, if it has
    no reference.
    """
    hypothesis, other = F.col("_hyp"), F.col("_against")
    free = F.col("is_qe") if "is_qe" in pairs.columns else F.col("ref").isNull()
    frame = pairs.select("*", scorer.prepare(F.col("hyp")).alias("_hyp"),
                         scorer.prepare(F.when(free, F.col("src")).otherwise(F.col("ref"))).alias("_against"))
    if scorer.shared:
        other = scorer.shared(hypothesis, other)
    return frame.select(*pairs.columns, scorer.compare(hypothesis, other).cast("double").alias(name))


def long_scores(scored: DataFrame, tasks: Sequence[Task] = NINE_TASKS,
                keys: Sequence[str] = ("seg_id",), name: str = "score") -> DataFrame:
    """Score columns as rows: keys, task, is_qe, score."""
    rows = F.array(*(F.struct(F.lit(t.label).alias("task"), F.lit(t.reference_free).alias("is_qe"),
                              F.col(t.label).alias(name)) for t in tasks if t.label in scored.columns))
    return scored.select(*keys, F.explode(rows).alias("_row")).select(*keys, "_row.*")


def attach_scores(triples: DataFrame, scores: DataFrame, tasks: Sequence[Task] = NINE_TASKS,
                  keys: Sequence[str] = ("seg_id",), value: str = "score") -> DataFrame:
    """Join long scores to their triples, one column per task.

    A task counts only if it has exactly one score for every triple and none
    besides; the column of any other task is left out with a warning. A triple
    without the hypothesis of a task may go without a score there, as it is not
    sent; it then has NULL. A triple key that is missing or repeated stops the
    job. All this is checked on keys and counts, in one grouping, before the
    texts are joined.
    """
    def counter(task: Task) -> str:
        return f"_n_{task.label}"

    texts = sorted({CANDIDATE[t.hyp] for t in tasks} & set(triples.columns))

    def missing(task: Task) -> Column:
        return F.col(f"_no_{CANDIDATE[task.hyp]}") if CANDIDATE[task.hyp] in texts else F.lit(False)

    rows = triples.select(*keys, F.lit(1).alias("_triple"), *(F.isnull(c).alias(f"_no_{c}") for c in texts)).unionByName(
        scores.select(*keys, F.col("task").alias("_task"), F.col(value).alias("_value")), allowMissingColumns=True)
    per_key = materialize(rows.groupBy(*keys).agg(
        F.count("_triple").alias("_triples"), *(F.max(f"_no_{c}").alias(f"_no_{c}") for c in texts),
        *(F.max(F.when(F.col("_task") == t.label, F.col("_value"))).alias(t.label) for t in tasks),
        *(F.count_if(F.col("_task") == t.label).alias(counter(t)) for t in tasks)), "pivoted")
    one = F.col("_triples") == 1
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    found = per_key.agg(
        F.count_if(F.col("_triples") > 1).alias("repeated"),
        F.count_if((F.col("_triples") > 0) & no_key).alias("nameless"),
        F.count_if(one).alias("expected"),
        *(F.coalesce(F.sum(counter(t)), F.lit(0)).alias(f"rows_{t.label}") for t in tasks),
        *(F.count_if(one & (F.col(counter(t)) == 1)).alias(f"matched_{t.label}") for t in tasks),
        *(F.count_if(one & (F.col(counter(t)) == 0) & missing(t)).alias(f"unsent_{t.label}") for t in tasks)).first()
    if found["repeated"] or found["nameless"]:
        raise ValueError(f"triples need a key each: {found['repeated']} keys are repeated, "
                         f"{'some are' if found['nameless'] else 'none is'} missing")
    complete = []
    for task in tasks:
        matched = found[f"matched_{task.label}"]
        if found[f"rows_{task.label}"] == matched == found["expected"] - found[f"unsent_{task.label}"]:
            complete.append(task.label)
        else:
            warnings.warn(f"{found[f'rows_{task.label}']} scores of {task.label} for "
                          f"{found['expected']} triples: left out", stacklevel=2)
    return (triples.join(per_key.filter(one).select(*keys, *complete), list(keys), "left")
            .select(*triples.columns, *complete))
