import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from triptych.functions.prompts import (
    german_prompt,
    identification_prompt,
    render,
    transliteration_prompt,
    urdu_prompt,
)
from triptych.operators.attempts import cost_summary, first_valid, tokens_made
from triptych.operators.compliance import (
    dataset_rules,
    is_native_script,
    is_roman_script,
    uses_bold,
    uses_phrase,
    violations,
)
from triptych.operators.curation import choose_candidates, one_per_key, override, pool_candidates, transliterate
from triptych.operators.stages import GERMAN, IDENTIFICATION, ModelGenerator, ReplayGenerator, Stage, run_stage
from triptych.plans.creation import create_dataset
from triptych.sources.shared import materialize, new_path, run_folder

ATTEMPTS = ("stage string, idiom_id long, attempt int, response string, "
            "prompt_tokens long, completion_tokens long")
GOOD, BAD = '{"english_sentence": "s%d", "target_A": "a"}', "no json"


def test_prompts(spark):
    row = spark.createDataFrame([("{idiom}", None, "x'\"y")], "i string, m string, g string").select(
        german_prompt(F.col("i"), F.col("m"), F.col("g")).alias("g"),
        identification_prompt(F.col("i"), F.col("m"), F.col("g")).alias("n"),
        urdu_prompt(F.lit("S"), F.lit("I"), F.lit("M"), F.lit("N"), F.lit("R")).alias("u"),
        transliteration_prompt(F.lit("R")).alias("t"),
        render("{a}{b}-{a}", a=F.lit(1), b=F.col("i")).alias("r")).first()
    assert "**{idiom}**" in row.g and '"x\'"y"' in row.g and "means: \n" in row.g
    assert row.r == "1{idiom}-1"
    for key in GERMAN.fields:
        assert key in row.g
    for key in IDENTIFICATION.fields:
        assert key in row.n
    assert all(f"target_{c}_{s}" in row.u for c in "ABC" for s in ("native", "roman"))


def test_first_valid_attempt(spark):
    rows = [("german", 1, 1, GOOD % 1), ("german", 1, 2, GOOD % 2), ("german", 2, 1, BAD),
            ("german", 2, 3, GOOD % 3), ("german", 3, 4, GOOD % 4), ("german", 4, 1, '{"target_A": "a"}'),
            ("german", 4, 2, "{}"), ("german", 4, 3, None), ("german", 5, 2, GOOD % 9),
            ("german", 5, 2, GOOD % 5)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], ATTEMPTS)
    got = first_valid(df, ["idiom_id"], ["english_sentence", "target_B"], ("english_sentence",))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 1, "s1", None), (2, 3, "s3", None), (5, 2, "s5", None)]
    assert first_valid(df, ["idiom_id"], ["target_A"]).count() == 4


def test_token_costs(spark):
    rows = [("german", 1, 1, BAD, 10, 1), ("german", 1, 2, GOOD % 1, 20, 2), ("german", 1, 3, GOOD % 1, 40, 4),
            ("german", 2, 1, None, None, None), ("german", 2, 2, BAD, 100, 10), ("german", 2, 3, BAD, 200, 20),
            ("german", 2, 4, GOOD % 1, 400, 40), ("urdu_ident", 1, 1, GOOD % 1, 1000, 2000)]
    df = spark.createDataFrame(rows, ATTEMPTS)
    made = {(r.stage, r.idiom_id): (r.attempts, r.prompt_tokens, r.completion_tokens)
            for r in tokens_made(df).collect()}
    assert made == {("german", 1): (2, 30, 3), ("german", 2): (3, 300, 30), ("urdu_ident", 1): (1, 1000, 2000)}
    costs = {r.stage: (r.prompt_tokens, r.completion_tokens, round(r.cost, 9))
             for r in cost_summary(tokens_made(df)).collect()}
    assert costs == {"german": (330, 33, 0.0066), "urdu_ident": (1000, 2000, 0.21),
                     "total": (1330, 2033, 0.2166)}


def test_a_third_of_all_attempts_under_one_key(spark):
    spread = spark.range(6000).select(
        F.lit("german").alias("stage"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("idiom_id"),
        (F.col("id") % 4 + 1).cast("int").alias("attempt"),
        F.when(F.col("id") % 5 == 0, F.format_string('{"english_sentence": "s%05d"}', "id"))
        .otherwise("none").alias("response"), F.lit(2).cast("long").alias("prompt_tokens"),
        F.lit(3).cast("long").alias("completion_tokens")).repartition(6)
    got = {r.idiom_id: r for r in first_valid(spread, ["idiom_id"], ["english_sentence"]).collect()}
    assert (got[7].attempt, got[7].english_sentence) == (1, "s00000")
    others = [i for i in range(6000) if i % 5 == 0 and i % 3 and i % 4 < 3]
    assert set(got) == {7, *others}
    made = {r.idiom_id: r for r in tokens_made(spread).collect()}
    # id 7 stands on its own too, as attempt 4
    assert made[7].attempts == 500 and made[7].prompt_tokens == 1000
    plan = first_valid(spread, ["idiom_id"], ["english_sentence"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def replay(spark, rows):
    return ReplayGenerator(spark.createDataFrame(rows, ATTEMPTS))


def test_retry_rounds(spark):
    rows = [("german", 1, 1, GOOD % 1, 1, 1), ("german", 1, 2, GOOD % 1, 1, 1),
            ("german", 2, 1, BAD, 1, 1), ("german", 2, 2, '{"target_A": 1}', 1, 1), ("german", 2, 3, GOOD % 2, 1, 1),
            ("german", 3, 1, BAD, 1, 1), ("german", 3, 2, "{}", 1, 1), ("german", 3, 4, GOOD % 3, 1, 1),
            ("german", 1, 1, None, None, None)]
    prompts = spark.createDataFrame([(i, f"p{i}", f"kept{i}") for i in (1, 2, 3, 4)],
                                    "idiom_id long, prompt string, `odd (x)` string")
    result = run_stage(GERMAN, prompts, replay(spark, rows), new_path(spark, "t"))
    made = sorted((r.idiom_id, r.attempt, r.prompt, r.reply is not None) for r in result.attempts.collect())
    assert made == [(1, 1, "p1", True), (2, 1, "p2", False), (2, 2, "p2", False), (2, 3, "p2", True),
                    (3, 1, "p3", False), (3, 2, "p3", False), (3, 3, "p3", False),
                    (4, 1, "p4", False), (4, 2, "p4", False), (4, 3, "p4", False)]
    assert sorted((r.idiom_id, r["odd (x)"], r.english_sentence) for r in result.replies.collect()) == [
        (1, "kept1", "s1"), (2, "kept2", "s2")]
    assert sorted((r.idiom_id, r.english_sentence) for r in result.settled.collect()) == [
        (1, "s1"), (2, "s2"), (3, None), (4, None)]
    assert sorted(r.idiom_id for r in result.rejected.collect()) == [3, 4]


def test_no_further_round_when_all_is_settled(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "p")], "idiom_id long, prompt string")
    run_stage(GERMAN, prompts, replay(spark, [("german", 1, 1, GOOD % 1, 1, 1)]), str(tmp_path))
    assert [p.name for p in (tmp_path / "german").iterdir()] == ["attempt=1"]
    with pytest.raises(PySparkException):  # a store belongs to one run
        run_stage(GERMAN, prompts, replay(spark, [("german", 1, 1, GOOD % 1, 1, 1)]), str(tmp_path))


def test_incomplete_round_is_written_anew(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "p")], "idiom_id long, prompt string")
    (tmp_path / "german" / "attempt=1").mkdir(parents=True)
    (tmp_path / "german" / "attempt=1" / "part-0.parquet").write_bytes(b"half a fi")
    result = run_stage(GERMAN, prompts, replay(spark, [("german", 1, 1, GOOD % 1, 1, 1)]), str(tmp_path),
                       resume=True)
    assert result.replies.first().english_sentence == "s1"


def logged(folder, answer):
    """A model that writes down its prompts; `answer` may raise."""
    def build():
        def ask(prompt):
            import uuid
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return answer(prompt)
        return ask
    return ModelGenerator(build, spread=2)


def test_resumed_run_asks_nothing_again(spark, tmp_path):
    (tmp_path / "log").mkdir()
    stage = Stage("s", ("a",))

    def answer(prompt):
        if prompt == "p2":
            raise TimeoutError
        return '  {"a": "' + prompt + '"} ', 3, 4
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "idiom_id long, prompt string")
    generator = logged(tmp_path / "log", answer)
    for _ in range(2):
        result = run_stage(stage, prompts, generator, str(tmp_path / "store"), resume=True)
        assert sorted((r.idiom_id, r.a) for r in result.replies.collect()) == [(0, "p0"), (1, "p1"), (3, "p3")]
        assert len(list((tmp_path / "log").iterdir())) == 6  # p2 three times, in the first run
    failed = result.attempts.filter("idiom_id = 2").collect()
    assert {(r.response, r.prompt_tokens, r.completion_tokens) for r in failed} == {(None, None, None)}
    assert cost_summary(result.attempts).filter("stage = 'total'").first().prompt_tokens == 9


def test_prompts_go_to_the_model_once_and_alone(spark):
    prompts = spark.createDataFrame([(1, "p", "k")], "idiom_id long, prompt string, other string")
    answered = ModelGenerator(lambda: lambda p: (p, 1, 1)).reply(prompts, "s", 1)
    assert answered.columns == ["idiom_id", "prompt", "other", "response", "prompt_tokens", "completion_tokens", "error"]
    plan = answered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan
    assert tuple(answered.first()) == (1, "p", "k", "p", 1, 1, None)


def test_model_without_tokens(spark):
    prompts = spark.createDataFrame([(1, "p")], "idiom_id long, prompt string")
    result = run_stage(Stage("s", ("a",)), prompts, ModelGenerator(lambda: lambda p: ('{"a": "x"}', None, None)),
                       new_path(spark, "t"))
    row = result.attempts.first()
    assert (row.response, row.prompt_tokens) == ('{"a": "x"}', None) and result.rejected.isEmpty()


def story_model():
    """Idiom i2 has no German, i3 no Urdu idiom, i4 a roman one only, i5 no translation."""
    def ask(prompt):
        idiom = next(f"i{n}" for n in range(1, 7) if f"i{n}" in prompt)
        if "german" in prompt.lower():
            reply = None if idiom == "i2" else {"english_sentence": f"use **{idiom}**", "target_A": f"G{idiom} da",
                                                "target_B": "b", "target_C": "c"}
        elif "target_A_native" in prompt:
            reply = None if idiom == "i5" else {
                f"target_{c}_{s}": {"native": "جل ", "roman": "jal "}[s] + (
                    {"native": "ن", "roman": f"r{idiom}"}[s] if c == "A" else c.lower() * (s == "roman"))
                for c in "ABC" for s in ("native", "roman")}
        else:
            reply = {"i3": {}, "i4": {"urdu_idiom_roman": "ri4", "urdu_idiom_native": ""}}.get(
                idiom, {"urdu_idiom_native": "ن", "urdu_idiom_roman": f"r{idiom}"})
        return ("Here:\n" + json.dumps(reply, ensure_ascii=False), 10, 1) if reply is not None else ("sorry", 10, 1)
    return ask


BASE = "idiom_id long, idiom string, meaning string, german_idiom string"


def test_dataset_job(spark):
    base = spark.createDataFrame([(n, f"i{n}", "m", f"Gi{n}") for n in range(1, 7)], BASE)
    run = create_dataset(base, ModelGenerator(story_model), new_path(spark, "job"))
    rows = {r["Idiom ID"]: r for r in run.dataset.collect()}
    assert sorted(rows) == [1, 3, 4, 5, 6] and len(run.dataset.columns) == 16
    assert rows[1]["English Sentence"] == "use **i1**" and rows[1]["German Target A (Figurative)"] == "Gi1 da"
    assert rows[1]["Urdu Native Target A (Idiomatic)"] == "جل ن"
    assert rows[1]["Urdu Roman Target C (Literal)"] == "jal c"
    assert rows[3]["Urdu Native Idiom"] is None and rows[3]["Urdu Roman Idiom"] is None
    assert rows[4]["Urdu Roman Idiom"] == "ri4" and rows[4]["Urdu Native Idiom"] == ""
    assert rows[5]["Urdu Native Idiom"] == "ن"
    for n in (3, 4, 5):
        assert all(rows[n][c] is None for c in run.dataset.columns[10:])
    assert {(r.stage, r.idiom_id) for r in run.rejected.collect()} == {
        ("german", 2), ("urdu_ident", 3), ("urdu_trans", 5)}
    costs = {r.stage: r.prompt_tokens for r in run.costs.collect()}
    assert costs == {"german": 80, "urdu_ident": 70, "urdu_trans": 50, "total": 200}
    broken = violations(run.dataset, "Idiom ID", dataset_rules(run.dataset.columns))
    assert [tuple(r) for r in broken.collect()] == [(4, "native texts are in their script")]


def test_curated_idioms_go_into_the_translation(spark):
    base = spark.createDataFrame([(n, f"i{n}", "m", f"Gi{n}") for n in (1, 3)], BASE)
    curated = spark.createDataFrame([(3, "ق", "qaf"), (9, "x", "y")],
                                    "idiom_id int, urdu_native string, urdu_roman string")
    run = create_dataset(base, ModelGenerator(story_model), new_path(spark, "job"), curated)
    rows = {r["Idiom ID"]: r for r in run.dataset.collect()}
    assert (rows[3]["Urdu Native Idiom"], rows[3]["Urdu Roman Idiom"]) == ("ق", "qaf")
    assert rows[3]["Urdu Native Target B (Descriptive)"] == "جل "
    assert rows[1]["Urdu Roman Idiom"] == "ri1"
    prompt = run.attempts.filter("stage = 'urdu_trans' and idiom_id = 3").first().prompt
    assert '"ق"' in prompt and '"qaf"' in prompt


def test_override_and_conflicts(spark):
    generated = spark.createDataFrame([(1, "g1", None), (2, "g2", "h2"), (3, None, None)],
                                      "idiom_id long, r string, n string")
    curated = spark.createDataFrame([(1, "c1", "d1"), (1, "c1", "d1"), (2, None, "d2")],
                                    "idiom_id long, cr string, cn string")
    rows = override(generated, curated, {"r": "cr", "n": "cn"}).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "c1", "d1"), (2, "g2", "d2"), (3, None, None)]
    clash = curated.union(spark.createDataFrame([(1, "other", "d1")], curated.schema))
    with pytest.raises(PySparkException):
        override(generated, clash, {"r": "cr"}).collect()
    assert one_per_key(curated, "idiom_id", ["cr"]).count() == 2


def test_candidate_choice(spark):
    def pool_of(*rows):
        return spark.createDataFrame(rows, "idiom_id long, candidate string")
    pool = pool_candidates({
        "first": pool_of((1, "f1"), (2, ""), (3, "f3"), (4, None), *((6, f"x{i:04}") for i in range(2000))),
        "second": pool_of((1, "s1"), (2, "s2"), (3, "s3"), (3, "s0")),
        "third": pool_of((2, "t2"), (4, "t4"), (5, "t5"))})
    choices = spark.createDataFrame([(3, "second"), (2, "first"), (5, "third"), (8, "first")],
                                    "idiom_id long, generator string")
    rows = choose_candidates(pool, choices, ["first", "second", "third"]).collect()
    assert sorted(tuple(r) for r in rows) == [
        (1, "first", "f1", False), (2, "second", "s2", False), (3, "second", "s0", True),
        (4, "third", "t4", False), (5, "third", "t5", True), (6, "first", "x0000", False)]
    with pytest.raises(PySparkException):
        choose_candidates(pool, choices, ["first", "second"]).collect()


def test_transliteration(spark):
    def build():
        return lambda prompt: ('{"urdu_idiom_native": "%s"}' % prompt.split('"')[1].upper(), 1, 1)
    curated = spark.createDataFrame([(1, "jal"), (2, "bin")], "idiom_id int, urdu_roman string")
    result = transliterate(curated, ModelGenerator(build), new_path(spark, "t"))
    assert sorted(tuple(r) for r in result.replies.collect()) == [(1, "JAL"), (2, "BIN")]


def test_phrase_and_script_rules(spark):
    rows = [("say **x** now", "x", True, True), ("say x", "x", False, True), ("**X**", "x", False, False),
            ("a.c", ".", False, True), ("abc", ".", False, False), (None, "x", False, False),
            ("x", None, False, False), ("x", "", False, False)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _, _) in enumerate(rows)], "i int, t string, p string")
    got = df.select("i", uses_bold(F.col("t"), F.col("p")).alias("b"),
                    uses_phrase(F.col("t"), F.col("p")).alias("u")).orderBy("i").collect()
    assert [(r.b, r.u) for r in got] == [(b, u) for _, _, b, u in rows]
    # Letters count, with presentation forms; an Arabic comma is none, and a native text has no Latin word.
    texts = [("jal", False, True), ("جل", True, False), ("جل x", False, False), ("12", False, False), (None, False, False),
             ("well، yes", False, True), ("\ufe9d\ufedd", True, False), ("،؟", False, False), ("é", False, True)]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", is_native_script(F.col("t")).alias("n"),
                    is_roman_script(F.col("t")).alias("r")).orderBy("i").collect()
    assert [(r.n, r.r) for r in got] == [(n, r) for _, n, r in texts]


def test_batches_of_prompts(spark):
    """A failed prompt, or a failed call, leaves the other prompts of its batch their replies; errors are kept."""
    def build():
        def ask(prompts):
            assert len(prompts) <= 4
            if len(prompts) > 1 and "p3" in prompts:
                raise TimeoutError("slow")
            if prompts == ["p5"]:
                return []
            return [KeyError("bad") if p == "p7" else (p.upper(), 1, 2) for p in prompts]
        return ask
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "idiom_id long, prompt string").repartition(3)
    rows = {r.idiom_id: r for r in ModelGenerator(build, prompts_per_call=4).reply(prompts, "s", 1).collect()}
    assert len(rows) == 12 and rows[7].response is None and rows[7].error == "KeyError: 'bad'"
    assert {i: r.response for i, r in rows.items() if i not in (5, 7)} == {i: f"P{i}" for i in range(12) if i not in (5, 7)}
    assert all(r.error is None and r.completion_tokens == 2 for i, r in rows.items() if i not in (5, 7))


def test_errors_are_kept_with_the_attempts(spark):
    def build():
        def ask(prompt):
            raise ConnectionError("no key")
        return ask
    prompts = spark.createDataFrame([(1, "p")], "idiom_id long, prompt string")
    result = run_stage(GERMAN, prompts, ModelGenerator(build), new_path(spark, "errors"))
    assert [(r.attempt, r.error) for r in result.attempts.orderBy("attempt").collect()] == [
        (n, "ConnectionError: no key") for n in (1, 2, 3)]
    assert [r.idiom_id for r in result.rejected.collect()] == [1] and result.replies.isEmpty()


def test_rounds_lie_apart_and_take_one_job_each(spark):
    def build():
        return lambda prompt: ('{"english_sentence": "x"}' if prompt.endswith("0") else "no", 1, 1)
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "idiom_id long, prompt string")
    spark.sparkContext.setJobGroup("rounds", "rounds")
    result = run_stage(GERMAN, prompts, ModelGenerator(build), new_path(spark, "rounds"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 2 * 3
    plan = result.rejected._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usable" in plan and "reply" not in plan.split("ReadSchema")[1]
    assert result.replies.count() == 4 and result.rejected.count() == 36 and result.settled.count() == 40


def test_a_run_leaves_nothing_behind(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    with run_folder(spark) as folder:
        frame = materialize(spark.range(5), "kept")
        assert Path(folder).exists() and set(shared.iterdir()) - before == {Path(folder)}
        frame.write.parquet(str(tmp_path / "out"))
    assert set(shared.iterdir()) == before and spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert str(shared) == str(Path(new_path(spark, "x")).parent)
