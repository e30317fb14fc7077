"""All queries against their SQL on the smallest tables, and their plans."""

from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from triptych.operators.tasks import NINE_TASKS
from triptych.sources.writers import request_groups, write_requests
from workload.oracle import ORACLE_SQL
from workload.queries import QUERIES
from workload.trial import connect, differences

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.filterwarnings("ignore:.*left out")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    problem, rows = differences(spark, con, SMALL, name)
    assert not problem
    assert rows > 0


@pytest.mark.filterwarnings("ignore:.*left out")
@pytest.mark.parametrize("name", ["request_reply_round_trip", "replies_by_line_order", "nine_task_scores_of_pairs"])
def test_incomplete_triples_agree_with_the_sql(spark, tmp_path, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 40 and doc_id not in (5, 8, 38, 39)")
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 14, "").otherwise(F.col("text")))
    docs.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    problem, rows = differences(spark, connect(str(tmp_path)), str(tmp_path), name)
    assert not problem
    assert rows > 0


@pytest.mark.filterwarnings("ignore:.*left out")
@pytest.mark.parametrize("name", ["request_reply_round_trip", "replies_by_line_order"])
def test_requests_lie_on_disk_for_one_group_of_tasks_at_a_time(spark, con, monkeypatch, name):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before, laid, lines = set(shared.rglob("requests-*")), [], {}

    def write(triples, path, tasks=NINE_TASKS, keys=("seg_id",)):
        write_requests(triples, path, tasks, keys)
        laid.append([x.name for p in set(shared.rglob("requests-*")) - before for x in p.glob("task=*")])
        lines.update({x.name: sum(len(p.read_text().splitlines()) for p in x.glob("*.json"))
                      for x in Path(path).glob("task=*")})

    monkeypatch.setattr("workload.queries.write_requests", write)
    monkeypatch.setattr("workload.queries.request_groups", partial(request_groups, most=1), raising=False)
    problem, rows = differences(spark, con, SMALL, name)
    assert not problem
    assert [len(x) for x in laid] == [1] * 9
    assert lines == {f"task={t.label}": rows for t in NINE_TASKS}
    assert set(shared.rglob("requests-*")) == before


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["lang", "section", "key", "value"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "nine_task_scores_wide", "report_rows", "win_rates_by_language", "first_valid_attempt",
    "token_cost_rollup", "curation_override", "candidate_pool_choice", "stage_gating",
    "phrase_compliance"])
def test_plans_have_no_cross_join_and_no_single_task(spark, name):
    plan = plan_of(contract.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan and "Window" not in plan


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(contract.queries()["report_rows"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    plan = plan_of(contract.queries()["row_limit_trial"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan


def test_report_shuffles_the_texts_once(spark):
    plan = plan_of(contract.queries()["report_rows"](spark, SMALL))
    assert plan.count("Exchange hashpartitioning") == 2  # triples, and the small summary
