"""Build task sets of changed texts from a response log or an earlier task set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmark.functions import noise as letter
from slipmark.functions import text
from slipmark.functions.draws import SEED
from slipmark.functions.lets import array_rows
from slipmark.functions.numbers import number_intervention
from slipmark.functions.specs import letter_parts, number_parts
from slipmark.operators import filters, joins, paging
from slipmark.operators.aggregates import first_wins
from slipmark.plans.scoring import Scorer
from slipmark.sources.scratch import stored


@dataclass
class TaskSet:
    """``rows``: question, target, part_no, perturbation, text. ``failures``: question, reason."""

    rows: DataFrame
    failures: DataFrame


def pads_by_default(taskset: str, perturbation: str) -> bool:
    return taskset != "test" or "transpose" in perturbation


def earlier_sets(earlier: DataFrame, parts: list[str]) -> DataFrame:
    """The rows of an earlier run (question, target, perturbation, text) whose question has all ``parts``, one for each part.

    One partial aggregate with a column for each part; of repeated rows of a part the largest one is taken.
    """
    fields = F.struct("target", "perturbation", "text")
    of = [F.max(F.when(F.col("perturbation") == p, fields)).alias(f"_{i}") for i, p in enumerate(parts)]
    held = earlier.where(F.col("perturbation").isin(parts)).groupBy("question").agg(*of).dropna(subset=[f"_{i}" for i in range(len(parts))])
    rows = F.array(*[F.struct(F.lit(i).alias("part_no"), F.col(f"_{i}").alias("r")) for i in range(len(parts))])
    return held.select("question", F.explode(rows).alias("e")).select(
        "question", "e.r.target", "e.part_no", "e.r.perturbation", "e.r.text")


def _not_in(rows: DataFrame, held: DataFrame | None, question: str = "question") -> DataFrame:
    return rows if held is None else joins.skip_completed(rows, held.select(question).distinct(), question)


def _merged(made: TaskSet, held: DataFrame | None) -> TaskSet:
    return made if held is None else TaskSet(held.unionByName(made.rows.select(*held.columns)), made.failures)


def _finish(made: DataFrame, order: list[str], limit: int) -> TaskSet:
    """First valid result per question, in order up to ``limit``; failures are questions with none.

    ``made`` has question, target, the order columns, ``made`` and ``reason``. It is stored, as filters on the changed texts
    would else be pushed into the text work and run it twice.
    """
    made = stored(made, "made")
    valid = made.where(F.size("made") > 0)
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    first = first_wins(valid, "question", place)
    kept = paging.skip_limit(first, order, 0, limit)
    rows = array_rows(kept, ["question", "target"], F.col("made")).drop("pos")
    named = made.where("question is not null")
    outcome = named.groupBy("question").agg(F.max(F.size("made") > 0).alias("any"), F.min("reason").alias("reason"))
    failed = outcome.where("not any").select("question", "reason")
    unnamed = made.where("question is null").select("question", F.lit("no question in the prompt").alias("reason"))
    return TaskSet(rows, failed.unionByName(unnamed))


def right_rows(
    log: DataFrame, model: str, style: str, order: list[str], key: str, skip: int = 0, sample_size: int = 0,
    sample_path: str | None = None, seed: str = SEED, scorer: Scorer = text.number_scorer,
) -> DataFrame:
    """Right answers of a model and style behind the first ``skip`` rows, or a sample of them."""
    rows = paging.skip_rows(log, order, skip) if skip else log
    rows = filters.correct_only(rows, model, style, scorer)
    if sample_size:
        by = ["model", "style"]
        sample = (
            paging.stored_sample(rows, key, sample_size, f"{sample_path}/{model.replace('/', '-')}", by)
            if sample_path
            else paging.draw_sample(rows.select(key), key, sample_size, seed)
        )
        rows = joins.keep_sample(rows, sample, key)
    return rows


def build_number_taskset(
    log: DataFrame,
    model: str,
    style: str = "sbs",
    taskset: str = "test",
    position: str = "copy",
    perturbation: str = "random",
    order: list[str] | None = None,
    key: str = "row_id",
    skip: int = 0,
    limit: int = -1,
    sample_size: int = 0,
    sample_path: str | None = None,
    done: DataFrame | None = None,
    min_adjust: int = -3,
    max_adjust: int = 3,
    handle_padding: bool | None = None,
    remove_steps: bool = True,
    nonnumeric: str = "",
    seed: str = SEED,
    scorer: Scorer = text.number_scorer,
    earlier: DataFrame | None = None,
) -> TaskSet:
    """Right answers of a model and style -> sample -> not yet done -> one changed text per spec part.

    ``done`` has questions to leave out. ``earlier`` has the rows of earlier maps (question, target, perturbation, text): questions
    that all of them hold are not made again, and their rows stand in the result next to the new ones.
    """
    order = order or [key]
    rows = right_rows(log, model, style, order, key, skip, sample_size, sample_path, seed, scorer)
    if done is not None:
        rows = joins.skip_completed(rows, done, "question")
    held = None
    if earlier is not None:
        held = stored(earlier_sets(earlier, [p.name for p in number_parts(perturbation, min_adjust, max_adjust)]), "earlier-sets")
        rows = _not_in(rows, held)
    padding = pads_by_default(taskset, perturbation) if handle_padding is None else handle_padding
    count = letter_parts(nonnumeric)[0].count if nonnumeric else 0
    made = number_intervention(
        F.col(key), F.coalesce("full_prompt", F.lit("")), position, perturbation, min_adjust, max_adjust, padding,
        remove_steps, seed, letter.matched_noise(count, seed) if count else None, reasons=True,
    )
    columns = dict.fromkeys(["question", "target", *order])
    return _merged(_finish(rows.select(*columns, made.alias("_out")).select(*columns, "_out.made", "_out.reason"), order, limit), held)


def letter_input_of_log(log: DataFrame, order: list[str]) -> DataFrame:
    """Question and reasoning of logged prompts; a prompt without a question gives a null question."""
    asked = F.col("question")
    return log.select(
        text.question_key(asked).alias("question"), text.prompt_reasoning(asked, F.col("full_prompt")).alias("reasoning"),
        "target", *order,
    )


def letter_input_of_original(
    log: DataFrame, model: str, style: str, order: list[str], key: str = "row_id", skip: int = 0, sample_size: int = 0,
    sample_path: str | None = None, seed: str = SEED, scorer: Scorer = text.number_scorer,
) -> DataFrame:
    """Question and reasoning of the right answers of the original log, behind its first ``skip`` rows, or of a sample of them."""
    return letter_input_of_log(right_rows(log, model, style, order, key, skip, sample_size, sample_path, seed, scorer), order)


def choose_letter_input(
    annotated: DataFrame, task_map: DataFrame, taskset: str, model: str, style: str, order: list[str]
) -> DataFrame:
    """The annotated log's rows of the right error type; the task map if there is none."""
    keep = filters.log_row_filter(taskset, model, style, strict=True)
    chosen = letter_input_of_log(annotated.where(keep), order)
    plain = task_map.select("question", "reasoning", "target", *order)
    one = lambda d: d.limit(1).select(F.lit(1).alias("_any"))
    return chosen.unionByName(
        plain.withColumn("_any", F.lit(1)).join(F.broadcast(one(chosen)), "_any", "left_anti").drop("_any")
    )


def build_letter_taskset(
    rows: DataFrame,
    perturbation: str = "typo10",
    order: list[str] | None = None,
    key: str = "row_id",
    limit: int = -1,
    done: DataFrame | None = None,
    seed: str = SEED,
    earlier: DataFrame | None = None,
) -> TaskSet:
    """Noisy texts of ``rows`` (question, reasoning, target): one per spec part; ``done`` and ``earlier`` as for number task sets."""
    order = order or [key]
    if done is not None:
        rows = joins.skip_completed(rows, done, "question")
    held = None
    if earlier is not None:
        held = stored(earlier_sets(earlier, [p.name for p in letter_parts(perturbation)]), "earlier-sets")
        rows = _not_in(rows, held)
    noisy = letter.letter_noise(F.col(key), F.coalesce("reasoning", F.lit("")), perturbation, seed)
    none = F.array().cast("array<struct<part_no:int,perturbation:string,text:string>>")
    made = F.when(F.col("question").isNotNull(), noisy).otherwise(none)
    columns = dict.fromkeys(["question", "target", *order])
    made_rows = rows.select(*columns, made.alias("made"), F.lit("too few letters").alias("reason"))
    return _merged(_finish(made_rows, order, limit), held)


def evaluation_questions(task_map: DataFrame, style: str) -> DataFrame:
    """The prompts that put a task set's changed texts to a model."""
    reasoning = F.col("text") if "text" in task_map.columns else F.col("reasoning")
    return task_map.withColumn("question", text.perturbed_prompt(F.col("question"), style, reasoning))
