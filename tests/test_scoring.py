import json
import math
import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triptych.operators.lexical import WORD_DISTANCE, WORD_OVERLAP, batch_overlap, nan_below
from triptych.operators.report import CALIBRATED, DISTANCE, JUDGE
from triptych.operators.scoring import (
    BatchScorer,
    ColumnScorer,
    _few,
    attach_scores,
    fail_whole_calls,
    failed_column,
    long_scores,
    score_pairs,
    score_triples,
)
from triptych.operators.stats import (
    averages,
    first_score_is_zero,
    summarize,
    win_rates,
)
from triptych.operators.tasks import NINE_TASKS, QE_TASKS, expand_tasks
from triptych.operators.triples import (
    drop_incomplete_triples,
    gather_triples,
    project_triples,
    scorer_frame,
)
from triptych.plans.evaluation import evaluate, evaluate_languages
from triptych.sources.profiles import PROFILES, union_languages
from triptych.sources.shared import materialize

TRIPLES = "seg_id long, src string, cand_a string, cand_b string, cand_c string"
SCORES = "g string, Score_QE_A double, Score_QE_B double, Score_QE_C double"
NAN = float("nan")


def random_triples(spark, n=200, seed=1):
    draw = random.Random(seed)

    def text():
        return " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 8)))
    return spark.createDataFrame([(i, text(), text(), text(), text()) for i in range(n)], TRIPLES)


def overlap(x, y):
    return float(100 * len(set(x.split(" ")) & set(y.split(" "))) // len(set(x.split(" "))))


def test_nine_tasks():
    assert [(t.label, t.hyp, t.ref) for t in NINE_TASKS] == [
        ("Score_QE_A", "A", None), ("Score_QE_B", "B", None), ("Score_QE_C", "C", None),
        ("Score_B_Ref_A", "B", "A"), ("Score_C_Ref_A", "C", "A"),
        ("Score_A_Ref_B", "A", "B"), ("Score_C_Ref_B", "C", "B"),
        ("Score_A_Ref_C", "A", "C"), ("Score_B_Ref_C", "B", "C")]


def test_all_forms_of_scoring_agree(spark):
    triples = random_triples(spark)
    wide = {r.seg_id: r for r in score_triples(triples, WORD_OVERLAP).collect()}
    batch = {r.seg_id: r for r in score_triples(triples, batch_overlap(), spread=3).collect()}
    pairs = {(r.seg_id, r.task): r for r in score_pairs(expand_tasks(triples), WORD_OVERLAP).collect()}
    rows = long_scores(score_triples(triples, WORD_OVERLAP)).collect()
    unpivoted = {(r.seg_id, r.task): r.score for r in rows}
    unpivoted_qe = {(r.seg_id, r.task): r.is_qe for r in rows}
    assert len(pairs) == len(unpivoted) == 200 * 9
    for seg_id, row in wide.items():
        texts = {"A": row.cand_a, "B": row.cand_b, "C": row.cand_c, None: row.src}
        for task in NINE_TASKS:
            want = overlap(texts[task.hyp], texts[task.ref])
            assert row[task.label] == batch[seg_id][task.label] == want
            assert pairs[seg_id, task.label].score == unpivoted[seg_id, task.label] == want
            assert pairs[seg_id, task.label].is_qe == task.reference_free
            assert unpivoted_qe[seg_id, task.label] == task.reference_free
            assert batch[seg_id][failed_column(task.label)] is False


def test_scoring_shuffles_nothing(spark):
    for scorer in (WORD_OVERLAP, batch_overlap()):
        plan = score_triples(random_triples(spark, 5), scorer)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert plan.count("ArrowEvalPython") == (0 if scorer is WORD_OVERLAP else 1)


def test_gathering_and_projection(spark):
    rows = spark.createDataFrame(
        [(0, "s", "en"), (1, "a", "x"), (2, "b", "x"), (3, "c", "x"), (4, "s2", "de"), (6, "b2", "x")],
        "i long, t string, lang string")
    triples = gather_triples(rows, {"seg_id": F.expr("i div 4")}, F.col("i") % 4, F.col("t"),
                             {"lang": F.col("lang")})
    assert sorted(tuple(r) for r in triples.collect()) == [
        (0, "s", "a", "b", "c", "en"), (1, "s2", None, "b2", None, "de")]
    assert [r.seg_id for r in drop_incomplete_triples(triples).collect()] == [0]
    roles = {"src": "t.x", "cand_a": "A", "cand_b": "B", "cand_c": "C"}
    df = spark.createDataFrame([("7", "s", "a", "b", "c", 1), ("8", None, "a", "b", "c", 2)],
                               "id string, `t.x` string, A string, B string, C string, more int")
    row = project_triples(df, roles, "id").collect()
    assert [(r.seg_id, r.src, r.cand_c, r.original["more"]) for r in row] == [(7, "s", "c", 1)]


def test_scorer_frame(spark):
    rows = scorer_frame(expand_tasks(random_triples(spark, 2)), "ur", ["seg_id", "task"]).collect()
    assert rows[0].__fields__ == ["src", "mt", "ref", "lp", "seg_id", "task", "system-name", "human_ratings"]
    assert {(r.lp, r["system-name"], r.human_ratings) for r in rows} == {("en-ur", "sys", 0.0)}
    assert all((r.ref == "") == r.task.startswith("Score_QE") for r in rows)


def picky(word, group_size=256, on_failure="zero"):
    def build():
        def score(sources, hypotheses, references):
            if word in hypotheses:
                raise ValueError(word)
            return [1.0] * len(hypotheses)
        return score
    return BatchScorer("picky", True, build, group_size, on_failure)


@pytest.mark.parametrize("on_failure", ["zero", "null"])
def test_failed_calls(spark, on_failure):
    rows = [(i, "s", "bad" if i == 17 else "ok", "ok", "ok", f"g{i % 3}") for i in range(60)]
    triples = spark.createDataFrame(rows, TRIPLES + ", g string").repartition(4)
    scorer = picky("bad", 5, on_failure)
    lost = 0.0 if on_failure == "zero" else None
    scored = materialize(score_triples(triples, scorer, QE_TASKS, call_group="g"), "scored")
    single = [r for r in scored.collect() if r.failed_Score_QE_A]
    assert 1 <= len(single) <= 5 and {r.g for r in single} == {"g2"}
    assert {r.Score_QE_A for r in single} == {lost}
    whole = fail_whole_calls(scored, scorer, QE_TASKS, "g").collect()
    assert len(whole) == 60
    for row in whole:
        assert row.Score_QE_A == (lost if row.g == "g2" else 1.0)
        assert row.failed_Score_QE_A == (row.g == "g2")
        assert row.Score_QE_B == row.Score_QE_C == 1.0 and not row.failed_Score_QE_B
    everything = fail_whole_calls(scored, scorer, QE_TASKS).collect()
    assert {r.Score_QE_A for r in everything} == {lost} and {r.Score_QE_B for r in everything} == {1.0}
    assert all(r.failed_Score_QE_A and not r.failed_Score_QE_C for r in everything)
    summary = summarize(fail_whole_calls(scored, scorer, QE_TASKS, "g"), True).first()
    assert summary.failed_Score_QE_A == 20 and summary.failed_Score_QE_B == 0


def test_missing_scores_of_a_model_stay_nan(spark):
    scorer = BatchScorer("holes", True, lambda: lambda s, h, r: [NAN if x == "n" else None if x == "m" else 2
                                                                 for x in h])
    triples = spark.createDataFrame([(1, "s", "n", "x", "x"), (2, "s", "m", "x", "x"), (3, "s", "x", "x", "n")],
                                    TRIPLES)
    scored = score_triples(triples, scorer, QE_TASKS)
    rows = {r.seg_id: r for r in scored.collect()}
    assert math.isnan(rows[1].Score_QE_A) and math.isnan(rows[2].Score_QE_A) and rows[3].Score_QE_A == 2.0
    assert not any(r.failed_Score_QE_A for r in rows.values())
    assert math.isnan(averages(scored, "propagate").filter("task = 'Score_QE_A'").first().average)
    assert averages(scored, "skip").filter("task = 'Score_QE_A'").first().average == 2.0


def test_wrong_number_of_scores_is_a_failure(spark):
    scorer = BatchScorer("short", True, lambda: lambda s, h, r: [1.0], on_failure="null")
    rows = score_triples(random_triples(spark, 4).coalesce(1), scorer, QE_TASKS).collect()
    assert all(r.Score_QE_A is None and r.failed_Score_QE_A for r in rows)


def test_failure_can_stop_the_job(spark):
    triples = spark.createDataFrame([(1, "s", "bad", "b", "c")], TRIPLES)
    with pytest.raises(Exception, match="bad"):
        score_triples(triples, picky("bad", on_failure="fail"), QE_TASKS).collect()
    with pytest.raises(ValueError):
        picky("bad", on_failure="sometimes")


def test_model_is_built_once_per_task_and_called_in_pieces(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path)

    def build():
        import uuid
        name = uuid.uuid4().hex

        def score(sources, hypotheses, references):
            with open(f"{log}/{name}", "a") as f:
                f.write(f"{len(hypotheses)}\n")
            return [0.0] * len(hypotheses)
        return score
    score_triples(random_triples(spark, 100).coalesce(1), BatchScorer("m", True, build, 30)).collect()
    assert not calls.exists()
    files = list(tmp_path.iterdir())
    assert len(files) == 1
    sizes = [int(x) for x in files[0].read_text().split()]
    assert sizes == [30, 30, 30, 10] * 9


def test_attach_scores(spark):
    triples = random_triples(spark, 30)
    scores = score_pairs(expand_tasks(triples), WORD_OVERLAP)
    attached = attach_scores(triples, scores.orderBy(F.rand(3)))
    want = score_triples(triples, WORD_OVERLAP)
    assert attached.columns == want.columns
    assert attached.exceptAll(want).isEmpty() and want.exceptAll(attached).isEmpty()


def test_few_texts_are_held_at_a_time():
    rows = [(0, "", "", i, "s" * (100 if i < 50 else 1), None if i == 7 else "t") for i in range(101)]
    columns = tuple(map(pa.array, zip(*rows, strict=True)))
    got = list(_few(iter([columns]), 4, 1000))
    assert max(len(part[3]) for part in got[:6]) == 8 and len(got) < 12
    assert [tuple(row) for part in got for row in zip(*part, strict=True)] == rows
    assert [len(part[3]) for part in _few(iter([columns]), 40, 1000)] == [40, 40, 21]


def test_missing_texts_have_no_score(spark):
    triples = spark.createDataFrame([(1, "x y", "x", "x y", "q"), (2, "x y", "x", None, None), (3, None, "x", "", "x")],
                                    TRIPLES)
    want = score_triples(triples, WORD_OVERLAP)
    assert want.filter("seg_id = 2 and Score_QE_A = 100 and Score_A_Ref_B = 0 and Score_B_Ref_A is null").count() == 1
    long = score_pairs(expand_tasks(triples), WORD_OVERLAP)
    for scores in (long, long.filter("score is not null")):
        attached = attach_scores(triples, scores)
        assert attached.columns == want.columns
        assert attached.exceptAll(want).isEmpty() and want.exceptAll(attached).isEmpty()
    with pytest.warns(UserWarning, match="Score_QE_A"):
        attach_scores(triples, long.filter("score is not null and not (task = 'Score_QE_A' and seg_id = 2)"))


@pytest.mark.parametrize("spoil", [
    lambda s: s.filter("not (task = 'Score_QE_B' and seg_id = 3)"),
    lambda s: s.filter("task <> 'Score_QE_B'"),
    lambda s: s.union(s.filter("task = 'Score_QE_B' and seg_id = 3")),
    lambda s: s.filter("not (task = 'Score_QE_B' and seg_id = 3)").union(
        s.filter("task = 'Score_QE_B' and seg_id = 4")),
    lambda s: s.withColumn("seg_id", F.when((F.col("task") == "Score_QE_B") & (F.col("seg_id") == 3), 999)
                           .otherwise(F.col("seg_id"))),
], ids=["one short", "absent", "one twice", "one for another", "unknown segment"])
def test_incomplete_tasks_are_left_out(spark, spoil):
    triples = random_triples(spark, 12)
    scores = score_pairs(expand_tasks(triples), WORD_OVERLAP).select("seg_id", "task", "score")
    with pytest.warns(UserWarning, match="Score_QE_B"):
        attached = attach_scores(triples, spoil(scores))
    labels = [t.label for t in NINE_TASKS if t.label != "Score_QE_B"]
    assert attached.columns == [*triples.columns, *labels] and attached.count() == 12
    pairs = win_rates(attached, True).collect()
    assert [r.pair for r in pairs] == ["AC"]
    assert "mean_Score_QE_B" not in summarize(attached, False, "skip", NINE_TASKS).columns


def test_missing_scores_lose_but_count(spark):
    rows = [("g", 2.0, 1.0, 1.0), ("g", NAN, 1.0, 1.0), ("g", 2.0, NAN, 1.0), ("g", 1.0, 1.0, 3.0),
            ("g", None, 1.0, 1.0), ("g", 1.0, None, 3.0), ("g", NAN, NAN, 1.0), ("g", 0.5, 1.0, None)]
    df = spark.createDataFrame(rows, SCORES)
    higher = {r.pair: r.win_rate for r in win_rates(df, True).collect()}
    lower = {r.pair: r.win_rate for r in win_rates(df, False).collect()}
    assert higher == {"AB": 1 / 8, "AC": 2 / 8, "BC": 0.0}
    assert lower == {"AB": 1 / 8, "AC": 2 / 8, "BC": 1 / 8}


def test_both_means(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0, NAN), ("g", 2.0, 4.0, NAN), ("g", NAN, None, NAN)], SCORES)
    spread = {r.task: r.average for r in averages(df, "propagate").collect()}
    skipped = {r.task: r.average for r in averages(df, "skip").collect()}
    assert math.isnan(spread["Score_QE_A"]) and spread["Score_QE_B"] == 2.5
    assert skipped == {"Score_QE_A": 1.5, "Score_QE_B": 2.5, "Score_QE_C": None}
    with pytest.raises(ValueError):
        averages(df, "ignore")


def test_no_rows(spark):
    df = spark.createDataFrame([], SCORES)
    assert [r.win_rate for r in win_rates(df, True).collect()] == [None] * 3
    assert [r.average for r in averages(df, "skip").collect()] == [None] * 3
    assert summarize(df, True).first().n_rows == 0


@pytest.mark.parametrize("seed", range(4))
def test_win_shares_add_up_for_any_layout(spark, seed):
    draw = random.Random(seed)
    values = [0.0, 1.0, 2.0, 3.0, NAN, None]
    rows = [(draw.choice("xy"), *(draw.choice(values) for _ in "abc")) for _ in range(400)]
    df = spark.createDataFrame(rows, SCORES)
    higher = {(r.g, r.pair): r.win_rate for r in win_rates(df, True, by=["g"]).collect()}
    lower = {(r.g, r.pair): r.win_rate for r in win_rates(df.repartition(7), False, by=["g"]).collect()}
    for group in "xy":
        mine = [r for r in rows if r[0] == group]
        for pair, i, j in (("AB", 1, 2), ("AC", 1, 3), ("BC", 2, 3)):
            known = [(r[i], r[j]) for r in mine if None not in (r[i], r[j])
                     and not (math.isnan(r[i]) or math.isnan(r[j]))]
            ties = sum(a == b for a, b in known)
            total = higher[group, pair] + lower[group, pair] + ties / len(mine)
            assert math.isclose(total + (len(mine) - len(known)) / len(mine), 1.0)
            assert higher[group, pair] == sum(a > b for a, b in known) / len(mine)


def test_scorer_variants(spark):
    triples = spark.createDataFrame([(1, "a b c", "a", "a b c d", "x y")], TRIPLES)
    row = score_triples(triples, nan_below(WORD_OVERLAP, 2), QE_TASKS).first()
    assert math.isnan(row.Score_QE_A) and (row.Score_QE_B, row.Score_QE_C) == (75.0, 0.0)
    row = score_triples(triples, WORD_DISTANCE, QE_TASKS).first()
    assert (row.Score_QE_A, row.Score_QE_B, row.Score_QE_C) == (0.0, 25.0, 100.0)
    assert first_score_is_zero(score_triples(triples, WORD_DISTANCE)).first()[0] is True
    assert first_score_is_zero(score_triples(triples, WORD_OVERLAP)).first()[0] is False


def test_scorer_without_a_shared_measure(spark):
    longer = ColumnScorer("longer", True, F.length, lambda h, other: h - other)
    triples = spark.createDataFrame([(1, "abc", "a", "ab", "abcdef")], TRIPLES)
    row = score_triples(triples, longer).first()
    assert (row.Score_QE_A, row.Score_B_Ref_A, row.Score_A_Ref_C) == (-2.0, 1.0, -5.0)
    rows = {r.task: r.score for r in score_pairs(expand_tasks(triples), longer).collect()}
    assert all(rows[t.label] == row[t.label] for t in NINE_TASKS)


def test_kinds_sort_as_they_should():
    assert [(k.name, k.higher_is_better, k.nan) for k in (JUDGE, CALIBRATED, DISTANCE)] == [
        ("judge", True, "propagate"), ("calibrated", True, "propagate"), ("distance", False, "skip")]


@pytest.mark.parametrize("partitions", [1, 4, 8])
@pytest.mark.filterwarnings("ignore:the first score")
def test_failures_do_not_depend_on_the_layout(spark, partitions):
    """The same 400 rows with one failing text and one missing text, however they lie."""
    rows = [(i, "s", None if i == 9 else "bad" if i == 17 else "ok", "ok", "ok") for i in range(400)]
    triples = spark.createDataFrame(rows, TRIPLES).repartition(partitions)
    whole = evaluate(triples, JUDGE, "de", picky("bad", 50, None)).summary.first()
    assert (whole.failed_Score_QE_A, whole.failed_Score_QE_B, whole.mean_Score_QE_A, whole.mean_Score_QE_B) == (400, 0, 0.0, 1.0)
    assert whole.error_Score_QE_A == "ValueError: bad" and whole.win_AB == 0.0
    by_row = evaluate(triples, JUDGE, "de", picky("bad", 50, None), whole_calls=False)
    row = by_row.summary.first()
    assert (row.failed_Score_QE_A, row.mean_Score_QE_A) == (1, 398 / 399)
    values = {r.seg_id: r for r in by_row.scored.collect()}
    assert values[17].Score_QE_A == 0.0 and values[9].Score_QE_A is None and not values[9].failed_Score_QE_A
    assert values[9].Score_QE_B == 1.0


def distances(word):
    def build():
        def score(sources, hypotheses, references):
            if word in hypotheses:
                raise ConnectionError("no " + word)
            return [5.0] * len(hypotheses)
        return score
    return BatchScorer("distance", False, build)


def test_a_failed_task_does_not_win_a_distance(spark):
    rows = [(i, "s", "a", "b", "c" if i else "gone") for i in range(20)]
    with pytest.warns(UserWarning, match="Score_QE_C failed and is left out: ConnectionError: no gone"):
        run = evaluate(spark.createDataFrame(rows, TRIPLES), DISTANCE, "de", distances("gone"))
    report = json.loads(run.report.first().report)
    assert set(report["win_rates"]) == {"A_beats_B"} and not [k for k in report["averages"] if "_C" in k.replace("Ref_C", "")]
    assert report["failed"] == {"Score_QE_C": 20, "Score_C_Ref_A": 20, "Score_C_Ref_B": 20}
    assert set(report["errors"].values()) == {"ConnectionError: no gone"}
    assert "Score_QE_C" not in run.results().columns
    with pytest.raises(ValueError, match="must not win"):
        BatchScorer("distance", False, distances("x").build, on_failure="zero")


def test_calibrated_scorers_stop_and_judges_warn(spark):
    triples = spark.createDataFrame([(1, "s", "bad", "b", "c")], TRIPLES)
    with pytest.raises(Exception, match="bad"):
        evaluate(triples, CALIBRATED, "de", picky("bad", on_failure=None))
    with pytest.warns(UserWarning, match="the first score is 0"):
        evaluate(triples, JUDGE, "de", picky("bad", on_failure=None))
    with pytest.raises(ValueError, match="unique"):
        evaluate(triples.union(triples), JUDGE, "de", picky("x", on_failure=None))


def test_a_failed_language_loses_its_task_only(spark):
    rows = [(i, "s", "a", "b", "gone" if i == 3 else "c") for i in range(5)]
    good = spark.createDataFrame(rows[:3], TRIPLES)
    triples = union_languages({"de": good, "ur-native": spark.createDataFrame(rows, TRIPLES)})
    with pytest.warns(UserWarning, match="Score_QE_C of ur-native failed"):
        _, reports = evaluate_languages(triples, DISTANCE, distances("gone"), ["de", "ur-native"])
    found = {r.language: json.loads(r.report) for r in reports.collect()}
    assert len(found["de"]["averages"]) == 9 and len(found["de"]["win_rates"]) == 3 and "failed" not in found["de"]
    assert len(found["ur-native"]["averages"]) == 6 and set(found["ur-native"]["win_rates"]) == {"A_beats_B"}


def test_calls_have_one_language_and_its_codes(spark):
    def coded():
        def score(sources, hypotheses, references, codes):
            assert len(set(sources)) == 1 and sources[0].startswith(codes.target + "|")
            return [len(codes.source)] * len(hypotheses)
        return score

    def framed():
        def score(frame):
            assert list(frame) == ["src", "mt", "ref", "lp", "seg_id", "system-name", "human_ratings"]
            assert frame.lp.nunique() == 1 and set(frame["system-name"]) == {"sys"}
            return [s * 10 + (r != "") for s, r in zip(frame.seg_id, frame.ref)]
        return score
    frames = {name: spark.createDataFrame([(i, p.code + "|", "a", "b", "c") for i in range(7)], TRIPLES)
              for name, p in PROFILES.items()}
    triples = union_languages(frames).repartition(2)
    scored, _ = evaluate_languages(triples, JUDGE, BatchScorer("coded", True, coded, takes="codes", on_failure="fail"))
    assert {r.Score_QE_A for r in scored.collect()} == {2.0} and scored.count() == 21
    scored, _ = evaluate_languages(triples, CALIBRATED, BatchScorer("framed", True, framed, takes="frame"))
    assert all(r.Score_QE_A == r.seg_id * 10 and r.Score_A_Ref_B == r.seg_id * 10 + 1 for r in scored.collect())
    own = {"xx": replace(PROFILES["de"], language="xx", code="xx")}
    alone = spark.createDataFrame([(1, "xx|", "a", "b", "c")], TRIPLES)
    run = evaluate(alone, JUDGE, "xx", BatchScorer("coded", True, coded, takes="codes", on_failure="fail"), profiles=own)
    assert run.scored.first().Score_QE_A == 2.0
    with pytest.raises(ValueError, match="language codes"):
        score_triples(alone, BatchScorer("coded", True, coded, takes="codes"))


@pytest.mark.parametrize("rows", [[(1, "s", "a", "b", "c")] * 2, [(None, "s", "a", "b", "c")]], ids=["repeated", "missing"])
def test_triple_keys_are_checked(spark, rows):
    triples = spark.createDataFrame(rows, TRIPLES)
    scores = spark.createDataFrame([(1, t.label, 1.0) for t in NINE_TASKS], "seg_id long, task string, score double")
    with pytest.raises(ValueError, match="need a key each"):
        attach_scores(triples, scores)


def test_calls_bounded_by_padded_length(spark, tmp_path):
    log = str(tmp_path)
    draw = random.Random(3)

    def text():
        return "w" * draw.choice([1, 5, 40, 300, 2000])
    rows = [(i, text(), text(), text(), text()) for i in range(120)]
    triples = spark.createDataFrame(rows, TRIPLES).coalesce(1)

    def build():
        import uuid
        name = uuid.uuid4().hex

        def score(sources, hypotheses, references):
            lengths = [len(s) + len(h) + len(r or "") for s, h, r in zip(sources, hypotheses, references or [None] * len(sources))]
            with open(f"{log}/{name}", "a") as f:
                f.write(f"{len(lengths)} {max(lengths)}\n")
            return [float(len(h)) for h in hypotheses]
        return score
    bounded = score_triples(triples, BatchScorer("m", True, build, 50, cost_per_call=3000)).collect()
    calls = [tuple(map(int, line.split())) for f in tmp_path.iterdir() for line in f.read_text().split("\n") if line]
    assert all(n * longest <= 3000 or n == 1 for n, longest in calls)
    assert any(n > 1 for n, _ in calls) and max(n for n, _ in calls) <= 50
    plain = score_triples(triples, BatchScorer("m", True, lambda: lambda s, h, r: [float(len(x)) for x in h])).collect()
    assert sorted(map(tuple, bounded)) == sorted(map(tuple, plain))
