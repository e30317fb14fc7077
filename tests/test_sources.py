import csv
import json
import random
import time
from pathlib import Path

import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from triptych.operators.cleaning import clean_base
from triptych.operators.lexical import WORD_OVERLAP, batch_overlap
from triptych.operators.ordinal import with_input_ordinal
from triptych.operators.report import JUDGE
from triptych.operators.scoring import score_triples
from triptych.operators.stats import win_rates
from triptych.operators.tasks import NINE_TASKS, QE_TASKS, expand_tasks
from triptych.plans.evaluation import evaluate
from triptych.sources.profiles import load_languages, load_triples, union_languages
from triptych.sources.readers import (
    BLOCK_COLUMN,
    FILE_COLUMN,
    INPUT_ORDER,
    read_base,
    read_curated,
    read_replies,
    read_reports,
    read_table,
)
from triptych.sources.shared import is_complete, materialize, new_path, shared_folder, shuffles_dropped
from triptych.sources.writers import output_path, request_groups, request_rows, write_requests, write_table


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_table_rules(spark, tmp_path):
    path = put(tmp_path, "t.csv", "﻿ id ,Text, ,Text\n"
               '1,"a ""b"", c\nd",,x\n2,NA,None," y "\n3,n/a\n\n4,\\,"",z\n')
    df = read_table(spark, path)
    assert df.columns == ["id", "Text", "", "Text.1"]
    rows = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert rows == {"1": ('a "b", c\nd', None, "x"), "2": (None, None, " y "),
                    "3": (None, None, None), "4": ("\\", None, "z")}


CELLS = ["x", "a b", "", "NA", "nan", "NaN ", " None", "null", "1.0", "007", 'q"q', '"', "a,b", "l\nb", "\\",
         "\\n", "é جل", " pad ", "\tt", "N/A", "-", "#N/A", "''"]


@pytest.mark.parametrize("seed", range(3))
def test_reading_agrees_with_pandas(spark, tmp_path, seed):
    draw = random.Random(seed)
    header = ["key", "Text (A)", "b.c", "d`e"]
    rows = [[str(i), *(draw.choice(CELLS) for _ in header[1:])] for i in range(300)]
    path = tmp_path / "random.csv"
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f, lineterminator="\n", quoting=draw.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
                   ).writerows([header, *rows])
    wanted = pd.read_csv(path, dtype=str)
    want = sorted(tuple(None if pd.isna(v) else v for v in r) for r in wanted.itertuples(index=False))
    got = read_table(spark, str(path))
    assert got.columns == list(wanted.columns) == header
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want


def test_pandas_reads_what_is_written(spark, tmp_path):
    rows = [(str(i), c, None) for i, c in enumerate(CELLS)]
    write_table(spark.createDataFrame(rows, "key string, `Text (A)` string, none string").coalesce(1),
                str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    frame = pd.read_csv(part, dtype=str, keep_default_na=False)
    assert [tuple(r) for r in frame.itertuples(index=False)] == [(k, c, "") for k, c, _ in rows]


def test_too_many_fields_stop_the_job(spark, tmp_path):
    path = put(tmp_path, "t.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(PySparkException):
        read_table(spark, path).collect()
    with pytest.raises(PySparkException):
        read_table(spark, path).select("a").collect()


def test_csv_round_trip(spark, tmp_path):
    texts = ['say "hi"', "a,b", "line\nbreak", " padded\t", "\\", 'end\\"', "ülker جل", "back\\slash,", '"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, `Text (A)` string")
    write_table(df, str(tmp_path / "out"))
    back = read_table(spark, str(tmp_path / "out"))
    assert [r[1] for r in sorted(back.collect(), key=lambda r: int(r[0]))] == texts


def test_base_idioms(spark, tmp_path):
    body = ("Idiom ,Meaning(s),Matching German Idiom\n"
            "\xa0break the ice\t, start talking ,das Eis brechen\n"
            "no meaning,,x\n \t ,m,g\nNA,m,g\nlast,m,null\nfinal,m,g\n")
    rows = clean_base(read_base(spark, put(tmp_path, "b.csv", body))).orderBy("idiom_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "break the ice", " start talking ", "das Eis brechen"), (1, "final", "m", "g")]
    with_id = "Idiom ID," + body.replace("\n", "\n7,", 6)
    rows = clean_base(read_base(spark, put(tmp_path, "c.csv", with_id))).collect()
    assert {r.idiom_id for r in rows} == {7}
    with pytest.raises(ValueError, match="Matching German Idiom"):
        read_base(spark, put(tmp_path, "d.csv", "Idiom,Meaning(s)\na,b\n"))


def test_base_as_parquet(spark, tmp_path):
    path = str(tmp_path / "base")
    spark.createDataFrame([(3, " a ", "m", "g")], ["Idiom ID", "Idiom ", "Meaning(s)",
                                                  "Matching German Idiom"]).write.parquet(path)
    assert tuple(clean_base(read_base(spark, path, "parquet")).first()) == (3, "a", "m", "g")


def test_curated(spark, tmp_path):
    path = put(tmp_path, "c.csv", "Idiom ID,English Idiom,Roman Urdu,Urdu Native\n"
               '1,"a, b","x, y",جل بن مچھلی\n2,c,d,"آ، ب"\n')
    rows = read_curated(spark, path).orderBy("idiom_id").collect()
    assert [tuple(r) for r in rows] == [(1, "a, b", "x, y", "جل بن مچھلی"), (2, "c", "d", "آ، ب")]


def test_replies(spark, tmp_path):
    good = '{"seg_id": 1, "task": "t", "prediction": 1.5}\n{"seg_id": 2, "task": "t", "prediction": "2e0"}\n'
    path = put(tmp_path, "r.json", good + '{"seg_id": 3, "task": "t", "prediction": NaN}\n')
    rows = {r.seg_id: r.prediction for r in read_replies(spark, path).collect()}
    assert rows[1] == 1.5 and rows[2] == 2.0 and rows[3] != rows[3]
    for bad in ('{"seg_id": 3, "task": "t"}\n', '{"seg_id": 3, "task": "t", "prediction": "high"}\n', "oops\n"):
        path = put(tmp_path, "bad.json", good + bad)
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_replies(spark, path).collect()
        assert read_replies(spark, path, on_bad="drop").count() == 2


def test_requests(spark, tmp_path):
    triples = spark.createDataFrame([(1, "s", "ä", "b", "c"), (2, "s2", "a2", "b2", "جل")],
                                    "seg_id long, src string, cand_a string, cand_b string, cand_c string")
    assert request_rows(triples).count() == 18
    write_requests(triples, str(tmp_path / "req"))
    folders = sorted(p.name for p in (tmp_path / "req").iterdir() if p.is_dir())
    assert folders == sorted(f"task={t.label}" for t in NINE_TASKS)
    lines = [json.loads(line) for p in (tmp_path / "req" / "task=Score_QE_A").glob("*.json")
             for line in p.read_text(encoding="utf-8").splitlines()]
    assert {"seg_id": 1, "source": "s", "hypothesis": "ä", "reference": ""} in lines
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "req").rglob("*.json"))
    assert "جل" in raw


def test_request_groups_hold_so_many_bytes(spark):
    triples = spark.createDataFrame([(1, "ss", "ä", "b", "c" * 9), (2, "s", "a", None, "c")],
                                    "seg_id long, src string, cand_a string, cand_b string, cand_c string")
    labels = [t.label for t in NINE_TASKS]  # bytes: src 3, A 3, B 1, C 10
    groups = request_groups(triples, most=20)
    assert [t.label for g in groups for t in g] == labels
    assert [[t.label for t in g] for g in groups][0] == ["Score_QE_A", "Score_QE_B"]  # 6 + 4; 13 more do not fit
    assert [len(g) for g in request_groups(triples, most=1)] == [1] * 9
    assert [len(g) for g in request_groups(triples)] == [9]
    assert request_groups(triples, []) == []
    assert [len(g) for g in request_groups(triples.filter("false"), most=1)] == [9]


def test_one_task_is_expanded_as_among_others(spark):
    triples = spark.createDataFrame([(1, "s", "a", "b", None), (2, None, None, "b2", "c2")],
                                    "seg_id long, src string, cand_a string, cand_b string, cand_c string")
    for task in NINE_TASKS:
        alone = expand_tasks(triples, [task])
        among = expand_tasks(triples).filter(F.col("task") == task.label)
        assert alone.columns == among.columns and dict(alone.dtypes) == dict(among.dtypes)
        assert sorted(map(str, alone.collect())) == sorted(map(str, among.collect()))
        assert "Generate" not in alone._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_are_dropped_at_the_end_of_a_query(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}

    already = held()
    with shuffles_dropped(spark):
        assert materialize(spark.range(100).repartition(3, "id"), "dealt").count() == 100
    deadline = time.monotonic() + 20  # files go soon after
    while not held() <= already and time.monotonic() < deadline:
        time.sleep(0.1)
    assert held() <= already
    assert spark.conf.get(name) == before


def test_reports_with_bare_nan(spark, tmp_path):
    path = put(tmp_path, "r.json", '{\n "language": "de",\n "averages": {"A": NaN, "B": "NaN", "C": 1.5},\n'
               ' "win_rate_A_vs_B": 0.5\n}')
    row = read_reports(spark, path).first()
    assert row.averages["A"] != row.averages["A"] and row.averages["B"] != row.averages["B"]
    assert row.averages["C"] == 1.5 and row.win_rate_A_vs_B == 0.5 and row.win_rates is None


def test_languages_of_one_file(spark, tmp_path):
    headers = ["English Sentence ", " German Target A (Figurative)", "German Target B (Alternative)",
               "German Target C (Literal Incorrect)"]
    headers += [f"Urdu {s} Target {c}" for s in ("Native", "Roman")
                for c in ("A (Idiomatic)", "B (Descriptive)", "C (Literal)")]
    rows = [["x y", "x y", "x", "q", "x z", "x y", "q", "n", "n", "n"],
            ["x y", "q", "x", "q", "x", "", "q", "x", "NA", "x"],
            ["u v", "u", "q", "q", "u", "q", "q", "u v", "u", "q"]]
    path = put(tmp_path, "all.csv", "\n".join(",".join(r) for r in [headers, *rows]) + "\n")
    frames = {lang: load_triples(spark, path, lang) for lang in ("de", "ur-native", "ur-roman")}
    assert {k: sorted(r.seg_id for r in v.collect()) for k, v in frames.items()} == {
        "de": [0, 1, 2], "ur-native": [0, 1], "ur-roman": [0, 1]}
    german = frames["de"].orderBy("seg_id").first()
    assert german.cand_c == "q" and german.original["German Target A (Figurative)"] == "x y"
    assert not set(INPUT_ORDER) & set(german.original.asDict())
    scored = union_languages({k: score_triples(v.drop("original"), WORD_OVERLAP, QE_TASKS)
                              for k, v in frames.items()})
    rates = {(r.language, r.pair): r.win_rate for r in win_rates(scored, True, by=["language"]).collect()}
    assert rates[("de", "AB")] == 1 / 3 and rates[("de", "BC")] == 2 / 3
    assert rates[("ur-native", "AB")] == 1 / 2 and rates[("ur-roman", "AC")] == 1 / 2
    keyed = path.replace("all.csv", "keyed.csv")
    (tmp_path / "keyed.csv").write_text("\n".join(
        ",".join(r) for r in [["Idiom ID", *headers], *(["%d" % (i + 5), *r] for i, r in enumerate(rows))]))
    together = load_languages(spark, keyed, ["ur-native", "ur-roman"], "Idiom ID").collect()
    assert sorted((r.language, r.seg_id, r.cand_a) for r in together) == [
        ("ur-native", 5, "x z"), ("ur-native", 7, "u"), ("ur-roman", 5, "n"), ("ur-roman", 7, "u v")]
    with pytest.raises(ValueError, match="cand_a"):
        load_triples(spark, put(tmp_path, "no.csv", "English Sentence,b\n1,2\n"), "de")
    with pytest.raises(PySparkException):
        load_triples(spark, str(tmp_path / "absent.csv"), "de")


def test_input_order_over_many_files(spark, tmp_path):
    for f in range(5):
        body = "".join(f'{f},{i},"a\nb{i}",c,d,e\n' for i in range(20 * (5 - f)))
        put(tmp_path, f"part-{f}.csv", "file,n,English Sentence,Target A,Target B,Target C\n" + body)
    rows = load_triples(spark, str(tmp_path), "de").orderBy("seg_id").collect()
    assert [r.seg_id for r in rows] == list(range(300))
    places = [(int(r.original["file"]), int(r.original["n"])) for r in rows]
    assert places == sorted(places)


def test_shared_folder(spark, tmp_path):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    path = new_path(spark, "x")
    assert not is_complete(spark, path)
    spark.range(3).write.parquet(path)
    assert is_complete(spark, path)
    copy = materialize(spark.range(4).select(F.col("id").alias("odd (name)")), "y")
    assert copy.columns == ["odd (name)"] and copy.count() == 4
    assert output_path("/out/", "distance", "german") == "/out/distance/german"


def test_files_with_another_header_stop_the_job(spark, tmp_path):
    put(tmp_path, "t/a.csv", "k,x,y\n1,2,3\n")
    put(tmp_path, "t/b.csv", "k,y,x\n1,2,3\n")
    with pytest.raises(Exception, match="(?s)header|CSV"):
        read_table(spark, str(tmp_path / "t")).collect()
    put(tmp_path, "u/a.csv", "k,x,y\n1,2,3\n")
    put(tmp_path, "u/b.csv", "k,x,y\n4,5,\n")
    assert sorted(tuple(r) for r in read_table(spark, str(tmp_path / "u")).collect()) == [
        ("1", "2", "3"), ("4", "5", None)]


def test_broken_rows_stop_a_splitting_read(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'k,x,y\n1,"a\nb",z\n2,c,d\n')
    assert sorted(tuple(r) for r in read_table(spark, path).collect()) == [("1", "a\nb", "z"), ("2", "c", "d")]
    with pytest.raises(Exception, match="line break"):
        read_table(spark, path, multiline=False).collect()
    short = put(tmp_path, "s.csv", "k,x,y\n1,2\n3,4,5\n")
    assert sorted(tuple(r) for r in read_table(spark, short).collect())[0] == ("1", "2", None)
    with pytest.raises(Exception, match="or fewer"):
        read_table(spark, short, multiline=False).collect()


def test_curated_columns_are_found_by_name(spark, tmp_path):
    path = put(tmp_path, "c.csv", "Urdu Native,Roman Urdu,English Idiom,Idiom ID\nق,qaf,e,1.0\nNA,r,f,2\n")
    rows = sorted(tuple(r) for r in read_curated(spark, path).collect())
    assert rows == [(1, "e", "qaf", "ق"), (2, "f", "r", None)]
    with pytest.raises(ValueError, match="Roman Urdu"):
        read_curated(spark, put(tmp_path, "d.csv", "Idiom ID,English Idiom,Urdu Native\n1,a,b\n"))


@pytest.mark.parametrize("multiline", [True, False])
def test_ordinals_of_a_scan(spark, tmp_path, multiline):
    """Rows of several files and blocks are numbered as they lie, without those left out; nothing but blocks is written."""
    for name in "ba":
        put(tmp_path, f"t/{name}.csv", "x,y\n" + "".join(f"{name}{i},{'' if i % 3 == 1 else i}\n" for i in range(400)))
    before = {p for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        table = read_table(spark, str(tmp_path / "t"), multiline, input_order=True)
        rows = with_input_ordinal(table.filter("y IS NOT NULL"), FILE_COLUMN, BLOCK_COLUMN, "n")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(x" not in plan and "rangepartitioning" not in plan
        got = [r.x for r in rows.orderBy("n").collect()]
        assert [r.n for r in rows.orderBy("n").collect()] == list(range(len(got)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{name}{i}" for name in "ab" for i in range(400) if i % 3 != 1]
    written = {p for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet")} - before
    assert written and all("blocks-" in str(p) for p in written)


def test_parquet_base_without_ids(spark, tmp_path):
    rows = [(f"i{i}" if i % 4 else " ", "m", "g") for i in range(30)]
    spark.createDataFrame(rows, ["Idiom", "Meaning(s)", "Matching German Idiom"]).coalesce(1).write.parquet(str(tmp_path / "b"))
    got = clean_base(read_base(spark, str(tmp_path / "b"), "parquet")).orderBy("idiom_id").collect()
    assert [(r.idiom_id, r.idiom) for r in got] == list(enumerate(f"i{i}" for i in range(30) if i % 4))


def test_ids_written_as_decimals(spark, tmp_path):
    head = "Idiom ID,Idiom,Meaning(s),Matching German Idiom\n"
    path = put(tmp_path, "b.csv", head + "1.0,a,m,g\n12,b,m,g\n,c,m,g\n3.,d,m,g\n1.0E1,e,m,g\n")
    assert {r.idiom: r.idiom_id for r in clean_base(read_base(spark, path)).collect()} == {
        "a": 1, "b": 12, "c": None, "d": 3, "e": 10}
    with pytest.raises(Exception, match="not a whole number: 1.5"):
        clean_base(read_base(spark, put(tmp_path, "c.csv", head + "1.5,a,m,g\n"))).collect()


def test_batch_scores_write_the_texts_once(spark, tmp_path):
    text = "".join(chr(97 + i * 7 % 26) for i in range(3000))
    body = "English Sentence,Target A,Target B,Target C\n" + "".join(
        f"{i}{text[i:]},{i}{text[i + 1:]},{i}{text[i + 2:]},{i}{text[i + 3:]}\n" for i in range(200))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p for p in shared.rglob("*.parquet")}
    triples = load_triples(spark, put(tmp_path, "t.csv", body), "de")
    evaluate(triples, JUDGE, "de", batch_overlap()).write(str(tmp_path / "out"))
    between = sum(p.stat().st_size for p in shared.rglob("*.parquet") if p not in before)
    results = sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet"))
    assert results > 100_000 and between < 0.2 * results
    assert spark.read.parquet(str(tmp_path / "out/judge/german/results")).count() == 200
