"""Physical plans: what must not be in them."""

import pytest
from pyspark.sql import functions as F

from slipmark.functions import noise, numbers, text
from slipmark.operators import aggregates, filters, joins, ordering
from slipmark.plans import evaluate
from slipmark.queries import views as V
from slipmark.queries.registry import all_queries

SMALL = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", [
    "number_intervention", "letter_noise", "number_plus_letter_noise", "tokenize_numbers", "number_scorer", "select_candidates",
])
def test_text_operators_stay_in_the_jvm(spark, key):
    shown = plan(all_queries()[key](spark, SMALL))
    assert "Python" not in shown and "BatchEval" not in shown


def test_number_texts_are_computed_once(spark):
    """A filter on the result must not be pushed below it, which would run the text work twice."""
    df = all_queries()["number_intervention"](spark, SMALL)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    project_and_filter = [l for l in optimized.splitlines() if "regexp_extract_all" in l]
    assert len(project_and_filter) == 1


@pytest.mark.parametrize("key", ["align_responses", "skip_completed", "matched_sets", "resume_anti_containment", "logprob_cache"])
def test_joins_are_equi_joins(spark, key):
    shown = plan(all_queries()[key](spark, SMALL))
    assert "NestedLoop" not in shown and "CartesianProduct" not in shown


def test_row_numbers_use_no_single_partition_window_over_rows(spark):
    df = ordering.number_rows(V.problems(spark, SMALL).select("row_id"), ["row_id"])
    shown = df._jdf.queryExecution().optimizedPlan().toString()
    # the only window runs over one row per range partition
    assert shown.count("Window [") == 1 and "count(1)" in shown


def test_filters_reach_the_log_table(spark, tmp_path):
    path = str(tmp_path / "log")
    V.response_log(spark, SMALL).write.partitionBy("model").parquet(path)
    log = spark.read.parquet(path)
    kept = log.where(filters.log_row_filter("test_adjusted_position-copy_x", "gpt-4-0314", "sbs")).select("row_id")
    shown = plan(kept)
    assert "PartitionFilters: [isnotnull(model" in shown and "EqualTo(style,sbs)" in shown
    assert "ReadSchema: struct<row_id:string,style:string,error_type:string>" in shown


def test_summary_is_a_partial_aggregate(spark):
    shown = plan(aggregates.score_summary(V.response_log(spark, SMALL), ["model", "style"]))
    assert "partial_count" in shown and "Window" not in shown


def test_plain_rows_are_not_shuffled_by_a_few_annotated_keys(spark):
    """All plain rows may have one model and style; they stay where they are."""
    plain = spark.range(0, 1000, 1, 4).selectExpr("id", "'m' || id % 2 as model", "if(id % 5 = 0, null, 's') as style")
    annotated = spark.sql("select 7L as id, 'm1' as model, 's' as style union all select 8L, 'm0', null")
    made = joins.prefer_annotated(annotated, plain, ["model", "style"])
    assert "SortMergeJoin" not in plan(made) and "hashpartitioning" not in plan(made)
    want = [7, 8] + [i for i in range(1000) if not (i % 2 and i % 5)]
    assert sorted(r.id for r in made.collect()) == sorted(want)


def test_an_evaluation_numbers_rows_only_for_its_summary(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(evaluate.aggregates, "chunk_summary", lambda *a, keep=evaluate.aggregates.chunk_summary: calls.append(1) or keep(*a))
    asked = spark.createDataFrame([(1, "q", "1"), (2, "r", "x")], "id long, question string, target string")
    run = lambda rows, attempt: rows.select("*", F.lit("1").alias("response"), F.lit("a").alias("start_ts"), F.lit("b").alias("end_ts"))
    made = evaluate.evaluate_dataset(asked, run, "m", "sbs", "test", ["id"], reruns=0)
    assert (made.rows.count(), made.failures.count(), calls) == (2, 1, [])
    assert [r.trials for r in made.summary.collect()] == [1] and len(calls) == 1
