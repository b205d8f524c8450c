"""Evaluate a data set, and score a recorded log again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmark.functions import fixed, text
from slipmark.operators import aggregates, containment, filters, joins, paging
from slipmark.operators.ordering import number_rows
from slipmark.plans.generate import rerun_failed
from slipmark.plans.scoring import Scorer
from slipmark.sources import problems
from slipmark.sources.scratch import stored


@dataclass
class Evaluation:
    """``rows``: each question with its last response and verdict. ``failures``: those without a verdict, and why. ``summary``: one row
    per page; the rows are only numbered for it, so this is done when it is asked for."""

    rows: DataFrame
    failures: DataFrame
    summarize: Callable[[], DataFrame]

    @cached_property
    def summary(self) -> DataFrame:
        return self.summarize()


def load_questions(spark: SparkSession, dataset: str, path: str, taskset: str | None = None, style: str = "sbs") -> DataFrame:
    """Questions and targets of a built-in set, or the prompts of a task set of changed texts."""
    taskset = taskset or fixed.DEFAULT_TASKSETS[dataset]
    if taskset in fixed.BUILT_IN_TASKSETS[dataset]:
        return problems.READERS[dataset](spark, path)
    task_map = problems.read_task_map(spark, path)
    asked = text.perturbed_prompt(F.col("question"), style, F.col("reasoning"))
    return task_map.withColumn("question", asked).drop("reasoning")


def evaluate_dataset(
    questions: DataFrame,
    run: Callable[[DataFrame, int], DataFrame],
    model: str,
    style: str,
    taskset: str,
    order: list[str],
    earlier: DataFrame | None = None,
    skip_condition: Callable[[Column], Column] | None = None,
    skip: int = 0,
    limit: int = -1,
    reruns: int = 1,
    scorer: Scorer = text.number_scorer,
    scorer_name: str = "number_scorer",
    page: int = fixed.PAGE_SIZE,
) -> Evaluation:
    """Not yet answered questions -> page -> responses -> score -> one summary row per ``page`` questions.

    ``run(rows, attempt)`` adds ``response``, ``start_ts`` and ``end_ts``; unanswered rows are run again ``reruns``
    times. ``earlier`` is the log so far: questions that one of its questions contains are left out.
    """
    rows = questions
    if earlier is not None:
        logged = earlier.where((F.col("model") == model) & (F.col("style") == style))
        rows = containment.drop_contained(rows, logged)
    if skip_condition is not None:
        rows = rows.where(~F.coalesce(skip_condition(F.col("question")), F.lit(False)))
    rows = paging.skip_limit(rows, order, skip, limit)
    tried = rerun_failed(stored(rows, "questions"), run, order, reruns)
    scored = tried.withColumnRenamed("response", "answer")

    def summarize() -> DataFrame:
        return aggregates.chunk_summary(scored, order, page, scorer).select(
            F.lit(taskset).alias("taskset"), F.lit(model).alias("model"), F.lit(style).alias("style"), "chunk", "trials",
            F.lit(scorer_name).alias("scorer"), "score", "start_time", "end_time",
        )

    verdict = scorer(F.col("answer"), F.col("target"))
    judged = scored.withColumn("ok", F.when(~text.is_blank(F.col("answer")), verdict))
    reason = F.when(text.is_blank(F.col("answer")), "no answer").otherwise("target can't be read")
    return Evaluation(judged, judged.where(F.col("ok").isNull()).select("question", "target", reason.alias("reason")), summarize)


def _skip_in_files(log: DataFrame, log_file: str, order: list[str], skip: int) -> DataFrame:
    """Without the first ``skip`` rows of each log file."""
    numbered = number_rows(log, [log_file, *order], "_row_no")
    first = numbered.groupBy(log_file).agg(F.min("_row_no").alias("_first"))
    return numbered.join(first, log_file).where(F.col("_row_no") - F.col("_first") >= skip).drop("_row_no", "_first")


def rescore_log(
    plain: DataFrame,
    taskset: str,
    model: str,
    style: str,
    log_file: str,
    order: list[str],
    annotated: DataFrame | None = None,
    skip: int = 0,
    limit: int = -1,
    scorer: Scorer = text.number_scorer,
    count_blank: bool = True,
) -> DataFrame:
    """The annotated log where there is one (per log file), filtered, scored, with one row per run of one model.

    ``skip`` leaves out the first rows of each log file, before any filter. A row without an answer is a wrong trial and counts
    for ``limit``; without ``count_blank`` such rows are left out.
    """
    keep = filters.log_row_filter(taskset, model, style)
    if skip:
        plain = _skip_in_files(plain, log_file, order, skip)
        annotated = None if annotated is None else _skip_in_files(annotated, log_file, order, skip)
    if annotated is None:
        rows = plain.withColumn("error_type", F.lit(None).cast("string")).where(keep)
    else:
        chosen = annotated.where(keep)
        unmarked = plain.drop("error_type").withColumn("error_type", F.lit(None).cast("string")).where(keep)
        rows = joins.prefer_annotated(chosen, unmarked, [log_file])
    rows = rows.withColumn("target", text.extract_target(F.col("target"), keep_commas=True))
    if limit >= 0:
        counts = F.lit(True) if count_blank else ~text.is_blank(F.col("answer"))
        rows = paging.limit_valid(rows, counts, order, limit)
    runs = aggregates.run_summary(rows, log_file, order, scorer, count_blank)
    return runs.select(
        F.lit(taskset).alias("taskset"), log_file, F.col("model").alias("model_family"), "model", "trials", "scorer",
        "score", "start_time", "end_time",
    )
