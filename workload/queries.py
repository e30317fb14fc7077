"""One query per operator group, over the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.functions.formats import cost_text, mean_text, rate_text
from triptych.functions.prompts import german_prompt, identification_prompt, urdu_prompt
from triptych.operators.attempts import cost_summary, first_valid, parse_attempts, tokens_made
from triptych.operators.cleaning import clean_base, first_rows, review_sample, review_sample_per_stratum
from triptych.operators.compliance import (
    dataset_rules,
    is_native_script,
    is_roman_script,
    uses_bold,
    uses_phrase,
    violations,
)
from triptych.operators.curation import (
    choose_candidates,
    override,
    pool_candidates,
    transliterate,
)
from triptych.operators.headers import resolve_roles, trim_headers
from triptych.operators.lexical import WORD_DISTANCE, WORD_OVERLAP, batch_overlap, nan_below
from triptych.operators.ordinal import with_ordinal
from triptych.operators.report import CALIBRATED, DISTANCE, JUDGE, report_long
from triptych.operators.scoring import (
    BatchScorer,
    Codes,
    ColumnScorer,
    Model,
    attach_scores,
    fail_whole_calls,
    failed_column,
    long_scores,
    score_pairs,
    score_triples,
)
from triptych.operators.stages import (
    GERMAN,
    IDENTIFICATION,
    URDU,
    Answer,
    AskMany,
    ModelGenerator,
    ReplayGenerator,
    assemble,
    run_stage,
)
from triptych.operators.stats import averages, first_score_is_zero, summarize, win_rates
from triptych.operators.tasks import NINE_TASKS, QE_TASKS, expand_tasks
from triptych.operators.triples import drop_incomplete_triples, scorer_frame
from triptych.plans.creation import create_dataset
from triptych.plans.evaluation import evaluate, evaluate_languages, write_reports
from triptych.sources.profiles import PROFILES, load_languages, load_triples, union_languages
from triptych.sources.readers import (
    read_base,
    read_curated,
    read_replies,
    read_reports,
    read_table,
)
from triptych.sources.shared import materialize, new_path, run_folder, shuffles_dropped
from triptych.operators.exact_sums import exact_means
from triptych.operators.journal import JournaledGenerator, read_journal
from triptych.sources.line_order import numbered_lines, replies_by_order
from triptych.sources.split_scan import read_split
from triptych.sources.swap import read_swapped, write_swapped
from triptych.sources.writers import output_path, request_groups, write_requests, write_table
from workload.tables import (
    conversation_triples,
    document_triples,
    event_attempts,
    part_idioms,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LEAST_WORDS = 20


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def triples_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_triples(spark, sf_dir).drop("lang", "source")


@query
def drop_incomplete_triples_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_incomplete_triples(conversation_triples(spark, sf_dir))


@query
def qe_scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_triples(document_triples(spark, sf_dir), WORD_OVERLAP, QE_TASKS)
    return scored.select("seg_id", *(t.label for t in QE_TASKS))


@query
def nine_task_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_scores(score_triples(document_triples(spark, sf_dir), WORD_OVERLAP))


@query
def nine_task_scores_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the expanded table, as an outside scorer has to do it."""
    pairs = expand_tasks(document_triples(spark, sf_dir))
    return score_pairs(pairs, WORD_OVERLAP).select("seg_id", "task", "is_qe", "score")


@query
def nine_task_scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_triples(document_triples(spark, sf_dir), WORD_OVERLAP)
    return scored.select("seg_id", *(t.label for t in NINE_TASKS))


def _conversation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = drop_incomplete_triples(conversation_triples(spark, sf_dir))
    return score_triples(triples, nan_below(WORD_OVERLAP, LEAST_WORDS))


@query
def averages_propagate_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages(_conversation_scores(spark, sf_dir), "propagate", NINE_TASKS, by=["conv_id"])


@query
def averages_skip_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages(_conversation_scores(spark, sf_dir), "skip", NINE_TASKS, by=["part"])


@query
def exact_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the nine tasks per conversation, the same to the last bit for any partitioning."""
    return exact_means(_conversation_scores(spark, sf_dir), [t.label for t in NINE_TASKS], ["conv_id"])


@query
def win_rates_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_rates(_conversation_scores(spark, sf_dir), True, by=["part"])


@query
def win_rates_higher_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_rates(score_triples(document_triples(spark, sf_dir), WORD_OVERLAP, QE_TASKS), True)


@query
def win_rates_lower_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_rates(score_triples(document_triples(spark, sf_dir), WORD_DISTANCE, QE_TASKS), False)


@query
def win_rates_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_triples(document_triples(spark, sf_dir), WORD_OVERLAP, QE_TASKS)
    return win_rates(scored, True, by=["lang"])


@query
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_triples(document_triples(spark, sf_dir), WORD_DISTANCE)
    summary = summarize(scored, False, DISTANCE.nan, NINE_TASKS, DISTANCE.pairs, by=["lang"])
    return report_long(summary, DISTANCE, PROFILES["de"].labels, by=["lang"])


@query
def report_rows_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_triples(document_triples(spark, sf_dir), WORD_OVERLAP, QE_TASKS)
    frames = []
    for kind in (JUDGE, CALIBRATED):
        summary = summarize(scored, True, kind.nan, kind.tasks, kind.pairs)
        frames.append(report_long(summary, kind, PROFILES["de"].labels)
                      .select(F.lit(kind.name).alias("kind"), "*"))
    return frames[0].unionByName(frames[1])


@query
def batch_scorer_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_triples(document_triples(spark, sf_dir), batch_overlap())
    return scored.select("seg_id", *(t.label for t in NINE_TASKS))


def _picky_model() -> Model:
    inner = batch_overlap().build()

    def score(sources: Sequence[str], hypotheses: Sequence[str],
              references: Sequence[str] | None) -> Sequence[float]:
        if any(" " not in h for h in hypotheses):
            raise ValueError("a hypothesis of one word")
        return inner(sources, hypotheses, references)
    return score


@query
def scorer_failure_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorer = BatchScorer("picky overlap", True, _picky_model, on_failure="zero")
    scored = score_triples(document_triples(spark, sf_dir), scorer, QE_TASKS, call_group="source")
    scored = materialize(scored.drop("src", "cand_a", "cand_b", "cand_c"), "picky")
    return fail_whole_calls(scored, scorer, QE_TASKS, "source").select(
        "seg_id", "source", *(c for t in QE_TASKS for c in (t.label, failed_column(t.label))))


@query
def judge_with_failed_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed call gives its whole task zeros, and is counted."""
    run = evaluate(document_triples(spark, sf_dir), JUDGE, "de", BatchScorer("picky overlap", True, _picky_model))
    return report_long(run.summary, JUDGE, PROFILES["de"].labels)


def _picky_distance() -> Model:
    inner = _picky_model()

    def score(*texts: Sequence[str] | None) -> Sequence[float]:
        return [100 - x for x in inner(*texts)]
    return score


@query
def distance_with_failed_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed task has neither an average nor a win, however low a zero would be."""
    run = evaluate(document_triples(spark, sf_dir), DISTANCE, "de",
                   BatchScorer("picky distance", False, _picky_distance))
    return report_long(run.summary, DISTANCE, PROFILES["de"].labels)


def _coded_model() -> Model:
    def score(sources: Sequence[str], hypotheses: Sequence[str], references: Sequence[str] | None,
              codes: Codes) -> Sequence[float]:
        return [float(len(h) % 7 + 10 * len(codes.target) + (codes.source == "en")) for h in hypotheses]
    return score


def _turned_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete triples as those of three languages."""
    triples = drop_incomplete_triples(document_triples(spark, sf_dir)).drop("lang", "source")
    return union_languages(dict.fromkeys(PROFILES, triples))


@query
def language_codes_at_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three languages in one job, for a scorer whose scores depend on the code of its call."""
    scorer = BatchScorer("coded", True, _coded_model, takes="codes")
    scored, _ = evaluate_languages(_turned_languages(spark, sf_dir), JUDGE, scorer)
    return scored.select("language", "seg_id", *(t.label for t in QE_TASKS))


def _report_entries(reports: DataFrame) -> DataFrame:
    parsed = F.from_json("report", "averages map<string,double>, win_rates map<string,double>")
    entries = F.concat(F.map_entries(parsed["averages"]), F.map_entries(parsed["win_rates"]))
    return reports.select("language", F.explode(entries).alias("_entry")).select(
        "language", "_entry.key", "_entry.value")


@query
def language_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of three languages that are scored in one job, written, read and as rows."""
    _, reports = evaluate_languages(_turned_languages(spark, sf_dir), CALIBRATED, WORD_OVERLAP)
    root = new_path(spark, "reports")
    write_reports(reports, root, CALIBRATED)
    entries = F.concat(F.map_entries("averages"), F.map_entries("win_rates"))
    return read_reports(spark, f"{root}/calibrated/*/report").select(
        "language", F.explode(entries).alias("_entry")).select("language", "_entry.key", "_entry.value")


QE_LABELS = [t.label for t in QE_TASKS]


def _outside_scorer(spark: SparkSession, requests: str) -> DataFrame:
    """What a scorer that only sees the request files replies."""
    sent = spark.read.schema("seg_id long, source string, hypothesis string, reference string, "
                             "task string").json(requests)
    pairs = sent.select("seg_id", "task", F.col("source").alias("src"),
                        F.col("hypothesis").alias("hyp"), F.col("reference").alias("ref"),
                        F.col("task").isin(QE_LABELS).alias("is_qe"))
    return score_pairs(pairs, WORD_OVERLAP, "prediction").select("seg_id", "task", "prediction")


@query
def request_reply_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer is run on some tasks at a time, whose requests go when they are answered."""
    with shuffles_dropped(spark):
        triples = materialize(document_triples(spark, sf_dir), "triples", "zstd")
    replies = new_path(spark, "replies")
    for tasks in request_groups(triples):
        with run_folder(spark):
            requests = new_path(spark, "requests")
            write_requests(triples, requests, tasks)
            _outside_scorer(spark, requests).write.mode("append").json(replies)
    scores = read_replies(spark, replies)
    attached = attach_scores(triples, scores, value="prediction")
    return attached.select("seg_id", *(t.label for t in NINE_TASKS))


LOST_REPLY = "Score_A_Ref_C"


@query
def replies_by_line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that answers line by line without keys; the replies of one task lack a line.

    It is run on some tasks at a time, whose requests go when the replies have their keys.
    """
    with shuffles_dropped(spark):
        triples = materialize(document_triples(spark, sf_dir), "triples", "zstd")
    scores = []
    for tasks in request_groups(triples):
        replies, keyed = new_path(spark, "replies"), new_path(spark, "scores")
        with run_folder(spark):
            requests = new_path(spark, "requests")
            write_requests(triples, requests, tasks)
            sent = numbered_lines(spark, requests).select("task", "place", F.from_json(
                "value", "source string, hypothesis string, reference string").alias("r"))
            pairs = sent.select("task", "place", F.col("r.source").alias("src"), F.col("r.hypothesis").alias("hyp"),
                                F.col("r.reference").alias("ref"), F.col("task").isin(QE_LABELS).alias("is_qe"))
            # Written down, as sorting by ranges reads its input twice.
            answered = materialize(score_pairs(pairs, WORD_OVERLAP, "prediction").filter(
                (F.col("task") != LOST_REPLY) | (F.col("place") != 0)).select("task", "place", "prediction"), "answered")
            answered.orderBy("task", "place").select("task", "prediction").write.partitionBy("task").json(replies)
            by_order = replies_by_order(spark, requests, replies)
            by_order.write.parquet(keyed)
        scores.append(spark.read.schema(by_order.schema).parquet(keyed))
    attached = attach_scores(triples, reduce(DataFrame.unionByName, scores), value="prediction")
    return attached.select("seg_id", *(t.label for t in NINE_TASKS if t.label != LOST_REPLY))


@query
def request_count_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task lacks the replies for one language, another has one score too many."""
    triples = materialize(document_triples(spark, sf_dir), "triples")
    pairs = expand_tasks(triples, keys=["seg_id", "lang"])
    lost = (F.col("task") == "Score_A_Ref_C") & (F.col("lang") == "fr")
    scores = score_pairs(pairs, WORD_OVERLAP).filter(~lost).select("seg_id", "task", "score")
    scores = scores.unionByName(scores.filter("task = 'Score_B_Ref_A' AND seg_id = 1"))
    return attach_scores(triples, scores).drop("src", "cand_a", "cand_b", "cand_c", "lang", "source")


@query
def csv_round_trip_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, lang = F.col("text"), F.col("lang")
    note = (F.when(lang == "de", F.concat(F.lit('"'), text, F.lit('"')))
            .when(lang == "fr", F.lit("None"))
            .when(lang == "es", F.concat(F.lit(" "), text, F.lit("\t")))
            .otherwise(F.concat(F.lit('\\", '), text, F.lit("\\"))))
    path = new_path(spark, "documents")
    write_table(table(spark, sf_dir, "documents").select("doc_id", "text", note.alias("note ")), path)
    return read_table(spark, path).withColumn("doc_id", F.col("doc_id").cast("long"))


@query
def quoted_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written with quoted line breaks (also CR LF) and read in blocks of a file."""
    path = new_path(spark, "quoted")
    text = F.concat(F.lit('a "q"\r\n'), F.col("text"), F.lit("\n\n"))
    write_table(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang"), path)
    return read_split(spark, path).select(F.col("doc_id").cast("long"), "text", "lang")


@query
def swapped_report_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per language swapped in; a second write fails half-way; readers still see the first."""
    path = new_path(spark, "swapped")
    docs = table(spark, sf_dir, "documents")
    write_swapped(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), path)
    broken = docs.select("lang", F.when(F.col("doc_id") == 0, F.raise_error(F.lit("stopped"))).otherwise(
        F.lit(1)).alias("one")).groupBy("lang").agg(F.sum("one").alias("n"))
    try:
        write_swapped(broken, path)
    except Exception as error:  # noqa: BLE001 - the failure is the point
        if "stopped" not in str(error):
            raise
    return read_swapped(spark, path)


@query
def header_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" Idiom ID "), F.col("c_name").alias("English Sentence\t"),
        F.col("c_mktsegment").alias(" German Target B (Alternative)"),
        F.col("c_nationkey").alias("Target A notes"),
        F.col("c_acctbal").alias("German Target A (Figurative) "),
        F.concat("c_name", F.lit("!")).alias("Target C"))
    trimmed = trim_headers(padded)
    roles = resolve_roles(trimmed.columns, PROFILES["de"].headers)
    return trimmed.select(F.col("Idiom ID").alias("seg_id"),
                          *(F.col(f"`{column}`").alias(role) for role, column in roles.items()))


@query
def blank_idiom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("Meaning(s)"), F.col("lang").alias("Matching German Idiom"),
        F.posexplode(F.split("text", "\n")).alias("line", "Idiom"))
    return clean_base(lines, ["doc_id", "line"])


@query
def base_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "base")
    idioms = part_idioms(spark, sf_dir)
    write_table(idioms.select(
        F.col("idiom_id").alias("Idiom ID"),
        F.concat(F.lit("  "), "idiom", F.lit("\t")).alias(" Idiom"),
        F.when(F.col("meaning") == "SMALL", F.lit("N/A")).otherwise(F.col("meaning"))
        .alias("Meaning(s)"),
        F.col("german_idiom").alias("Matching German Idiom ")), path)
    return clean_base(read_base(spark, path))


@query
def curated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "curated")
    write_table(part_idioms(spark, sf_dir).select(
        F.col("idiom_id").alias("Idiom ID"), F.col("idiom").alias("English Idiom"),
        F.concat("meaning", F.lit(", "), "german_idiom").alias("Roman Urdu"),
        F.translate("idiom", "aeion", "اےیون").alias("Urdu Native")), path)
    return read_curated(spark, path)


@query
def row_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return with_ordinal(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "seg_id")


@query
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    idiom, meaning, german = F.col("idiom"), F.col("meaning"), F.col("german_idiom")
    sentence = F.concat(F.lit("It is a "), idiom)
    return part_idioms(spark, sf_dir).select(
        "idiom_id",
        german_prompt(idiom, meaning, german).alias("german_prompt"),
        identification_prompt(idiom, meaning, sentence).alias("identification_prompt"),
        urdu_prompt(sentence, idiom, meaning, german, meaning).alias("urdu_prompt"))


@query
def extract_json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_attempts(event_attempts(spark, sf_dir))
    reply = F.col("reply")
    return parsed.select(
        "event_id", reply.isNotNull().alias("valid"),
        F.element_at(reply, "english_sentence").alias("english_sentence"),
        F.element_at(reply, "target_A").alias("target_a"),
        F.element_at(reply, "urdu_idiom_roman").alias("urdu_idiom_roman"),
        F.element_at(reply, "target_C_roman").alias("target_c_roman"))


@query
def first_valid_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_valid(event_attempts(spark, sf_dir), ["stage", "idiom_id"],
                       ["english_sentence", "urdu_idiom_roman", "target_A_native"])


def _stage_replies(attempts: DataFrame, stage) -> DataFrame:
    return first_valid(attempts.filter(F.col("stage") == stage.name), ["idiom_id"],
                       stage.fields, stage.required)


@query
def stage_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = event_attempts(spark, sf_dir)
    return assemble(part_idioms(spark, sf_dir),
                    *(_stage_replies(attempts, s) for s in (GERMAN, IDENTIFICATION, URDU)))


def _recorded(spark: SparkSession, sf_dir: str) -> ReplayGenerator:
    """The attempts as a table, so that every round reads just its own."""
    path = new_path(spark, "recorded")
    event_attempts(spark, sf_dir).write.partitionBy("stage", "attempt").parquet(path)
    schema = event_attempts(spark, sf_dir).schema
    return ReplayGenerator(spark.read.schema(schema).parquet(path))


@query
def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    idioms = part_idioms(spark, sf_dir)
    prompts = idioms.select("idiom_id", german_prompt(
        F.col("idiom"), F.col("meaning"), F.col("german_idiom")).alias("prompt"))
    result = run_stage(GERMAN, prompts, _recorded(spark, sf_dir),
                       new_path(spark, "retry"))
    return result.attempts.select("idiom_id", "attempt", "prompt_tokens",
                                  F.col("reply").isNotNull().alias("valid"))


def _answer_in_capitals(prompt: str) -> tuple[str, int, int]:
    return json.dumps({"english_sentence": prompt.upper()}), len(prompt), 1


def _capitals_model():
    return _answer_in_capitals


@query
def journal_resume_changed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage run twice on one store and journal; a tenth of the prompts changed in between.

    `asked` is how many prompts of the row the model saw over both runs: 2 for the changed ones.
    """
    parts = table(spark, sf_dir, "part")
    store, model = new_path(spark, "store"), JournaledGenerator(_capitals_model, new_path(spark, "journal"))
    changed = F.col("p_partkey") % 10 == 0
    for prompt in (F.col("p_name"), F.when(changed, F.concat("p_name", F.lit(" (revised)"))).otherwise(F.col("p_name"))):
        result = run_stage(GERMAN, parts.select(F.col("p_partkey").cast("long").alias("idiom_id"),
                                                prompt.alias("prompt")), model, store, resume=True)
    asked = read_journal(spark, model.folder(GERMAN.name, 1)).groupBy("idiom_id").agg(F.count(F.lit(1)).alias("asked"))
    return result.replies.select("idiom_id", "english_sentence").join(asked, "idiom_id")


def _reviewed_idioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reviewed idioms; they cover some of the ids."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("idiom_id"), F.concat(F.lit("q"), "quality").alias("urdu_roman"),
        F.concat(F.lit("t"), "toxic").alias("urdu_native"))


@query
def dataset_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = create_dataset(part_idioms(spark, sf_dir), _recorded(spark, sf_dir),
                         new_path(spark, "creation"), _reviewed_idioms(spark, sf_dir))
    return run.dataset


@query
def created_dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a created dataset that break the rules of their prompts."""
    dataset = materialize(dataset_creation(spark, sf_dir), "dataset")
    return violations(dataset, "Idiom ID", dataset_rules(dataset.columns))


LENGTHS = ColumnScorer("lengths", True, F.length, lambda h, other: h * 10 + other)


@query
def created_dataset_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From base idioms to reports: a created dataset is written, read per language, scored and reported on."""
    path = new_path(spark, "dataset")
    write_table(dataset_creation(spark, sf_dir), path)
    triples = load_languages(spark, path, list(PROFILES), key="Idiom ID")
    _, reports = evaluate_languages(triples, CALIBRATED, LENGTHS)
    return _report_entries(reports)


@query
def token_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokens_made(event_attempts(spark, sf_dir))
    return cost_summary(made).withColumn("cost", F.round("cost", 6))


@query
def curation_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    generated = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idiom_id"), F.col("source").alias("urdu_idiom_roman"),
        F.col("lang").alias("urdu_idiom_native"))
    return override(generated, _reviewed_idioms(spark, sf_dir),
                    {"urdu_idiom_roman": "urdu_roman", "urdu_idiom_native": "urdu_native"})


@query
def candidate_pool_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, conversation turns and page addresses as three generators."""
    pool = pool_candidates({
        "documents": table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("idiom_id"), F.col("text").alias("candidate")),
        "turns": table(spark, sf_dir, "conversations").select(
            F.col("conv_id").alias("idiom_id"), F.col("text").alias("candidate")),
        "pages": table(spark, sf_dir, "pages").select(
            F.col("page_id").alias("idiom_id"), F.col("url").alias("candidate"))})
    choices = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("idiom_id"),
        F.when(F.col("toxic") == 1, "pages").when(F.col("quality") == 1, "documents")
        .otherwise("turns").alias("generator"))
    return choose_candidates(pool, choices, ["turns", "pages", "documents"])


def _reverse_model() -> AskMany:
    def answer(prompt: str) -> Answer | Exception:
        idiom = prompt.split('"')[1]
        if idiom.endswith("9"):
            return ConnectionError("no answer")
        text = '{"urdu_idiom_native": "%s"}' % idiom[::-1]
        return f"```json\n{text}\n```", len(prompt), len(text)

    def ask(prompts: list[str]) -> list[Answer | Exception]:
        if len(prompts) > 1 and any(p.split('"')[1].endswith("7") for p in prompts):
            raise TimeoutError("too much at once")
        return [answer(p) for p in prompts]
    return ask


@query
def transliteration_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("idiom_id"), F.col("s_name").alias("urdu_roman"))
    result = transliterate(curated, ModelGenerator(_reverse_model, prompts_per_call=16), new_path(spark, "transliteration"))
    return result.replies


def _idiom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second word of the source as idiom, in bold in English sources."""
    triples = document_triples(spark, sf_dir)
    triples = triples.withColumn("idiom", F.get(F.split("src", " "), F.lit(1)))
    bold = F.concat(F.lit("**"), "idiom", F.lit("**"))
    return triples.withColumn("sentence", F.when(
        (F.col("lang") == "en") & F.col("idiom").isNotNull(),
        F.replace("src", F.col("idiom"), bold)).otherwise(F.col("src")))


@query
def phrase_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    idiom = F.col("idiom")
    return _idiom_rows(spark, sf_dir).select(
        "seg_id", uses_bold(F.col("sentence"), idiom).alias("sentence_bold"),
        *(uses_phrase(F.col(f"cand_{c}"), idiom).alias(f"{c}_uses_idiom") for c in "abc"))


@query
def phrase_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    idiom = F.col("idiom")
    return violations(_idiom_rows(spark, sf_dir), "seg_id", {
        "bold": uses_bold(F.col("sentence"), idiom),
        "A uses the idiom": uses_phrase(F.col("cand_a"), idiom)})


@query
def script_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("lang") == "en", F.translate("text", "aeion", "اےیون")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", is_native_script(text).alias("native_ok"), is_roman_script(text).alias("roman_ok"))


@query
def review_sample_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_sample(table(spark, sf_dir, "documents"), "doc_id", 20).select(
        "doc_id", "lang", "n_chars")


@query
def review_sample_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 25 documents of each language (of each source within it), always the same ones."""
    return review_sample_per_stratum(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", 25).select(
        "doc_id", "lang", "source", "n_chars")


@query
def row_limit_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(part_idioms(spark, sf_dir), "idiom_id", 3)


@query
def formatted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_triples(document_triples(spark, sf_dir), WORD_OVERLAP, QE_TASKS)
    summary = summarize(scored, True, by=["lang"])
    return summary.select("lang", "n_rows", *(mean_text(F.col(f"mean_{t.label}")).alias(f"mean_{t.hyp.lower()}")
                                    for t in QE_TASKS), rate_text(F.col("win_AB")).alias("win_ab"))


@query
def formatted_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokens_made(event_attempts(spark, sf_dir))
    return cost_summary(made).select("stage", cost_text(F.round("cost", 6)).alias("cost"))


@query
def scorer_frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = document_triples(spark, sf_dir)
    pairs = expand_tasks(triples, NINE_TASKS, keys=["seg_id", "lang"])
    return scorer_frame(pairs, F.col("lang"), keys=["seg_id", "task"])


def _language_file(spark: SparkSession, sf_dir: str) -> str:
    """A finished table as the dataset job writes it, candidates turned per language."""
    path = new_path(spark, "languages")
    a, b, c = "cand_a", "cand_b", "cand_c"
    headers = {
        "German Target A (Figurative)": a, "German Target B (Alternative)": b,
        "German Target C (Literal Incorrect)": c,
        "Urdu Native Target A (Idiomatic)": b, "Urdu Native Target B (Descriptive)": c,
        "Urdu Native Target C (Literal)": a,
        "Urdu Roman Target A (Idiomatic)": c, "Urdu Roman Target B (Descriptive)": a,
        "Urdu Roman Target C (Literal)": b}
    write_table(document_triples(spark, sf_dir).select(
        F.col("seg_id").alias("Idiom ID"), F.col("src").alias("English Sentence"),
        *(F.col(column).alias(name) for name, column in headers.items())), path)
    return path


@query
def language_configured_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _language_file(spark, sf_dir)
    german = load_triples(spark, path, "de", key="Idiom ID").drop("original")
    urdu = load_languages(spark, path, ["ur-native", "ur-roman"], key="Idiom ID")
    triples = union_languages({"de": german}).unionByName(urdu)
    return win_rates(score_triples(triples, WORD_OVERLAP, QE_TASKS), True, by=["language"])


@query
def segment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = load_triples(spark, _language_file(spark, sf_dir), "de", key="Idiom ID")
    root = new_path(spark, "results")
    evaluate(triples, CALIBRATED, "de", WORD_OVERLAP).write(root)
    results = spark.read.parquet(f"{output_path(root, 'calibrated', 'german')}/results")
    return results.select(F.col("Idiom ID").cast("long").alias("seg_id"),
                          F.col("German Target B (Alternative)").alias("cand_b"),
                          *(c for c in results.columns if c.startswith("Score_")))


@query
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = document_triples(spark, sf_dir)
    root = new_path(spark, "reports")
    evaluate(triples, DISTANCE, "de", WORD_DISTANCE, note="lower is better").write(root)
    report = read_reports(spark, f"{output_path(root, 'distance', 'german')}/report")
    entries = F.concat(F.map_entries("averages"), F.map_entries("win_rates"))
    return (report.select("language", "note", F.explode(entries).alias("_entry"))
            .select("language", "note", "_entry.key", "_entry.value"))


@query
def first_score_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_triples(document_triples(spark, sf_dir), WORD_OVERLAP, QE_TASKS)
    return first_score_is_zero(scored)
