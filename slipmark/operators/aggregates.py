"""Score summaries and one-row-per-question reductions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmark.functions.text import is_blank, number_scorer
from slipmark.operators.ordering import number_rows
from slipmark.sources.scratch import stored


def scored_rows(log: DataFrame, scorer=number_scorer) -> DataFrame:
    """Rows with an answer, with the verdict ``ok``; blank answers are failures and are left out."""
    return log.where(~is_blank(F.col("answer"))).withColumn("ok", scorer(F.col("answer"), F.col("target")))


def summary_columns(name: str = "number_scorer") -> list[Column]:
    return [
        F.count("ok").alias("trials"),
        F.avg(F.col("ok").cast("double")).alias("score"),
        F.lit(name).alias("scorer"),
        F.min("start_ts").alias("start_time"),
        F.max("end_ts").alias("end_time"),
    ]


def score_summary(log: DataFrame, by: list[str], scorer=number_scorer, name: str = "number_scorer") -> DataFrame:
    """Trials, score and times per group; groups without a scored row give no row."""
    grouped = scored_rows(log, scorer).groupBy(*by).agg(*summary_columns(name))
    return grouped.where(F.col("trials") > 0)


def chunk_summary(log: DataFrame, order: list[str], size: int = 100, scorer=number_scorer) -> DataFrame:
    """One summary row per ``size`` questions in order; a chunk without a scored row gives none.

    What is stored to number the rows is the verdict and the times alone.
    """
    verdict = F.when(~is_blank(F.col("answer")), scorer(F.col("answer"), F.col("target")))
    slim = log.select(*order, verdict.alias("ok"), *_times(log, ~is_blank(F.col("answer"))))
    numbered = number_rows(slim, order, keep=["ok", "start_ts", "end_ts"]).withColumn("chunk", F.floor(F.col("row_no") / size))
    return numbered.groupBy("chunk").agg(*summary_columns()).where(F.col("trials") > 0)


def _times(log: DataFrame, counts: Column) -> list[Column]:
    """The times of the rows that count."""
    return [F.when(counts, F.col(c)).alias(c) for c in ("start_ts", "end_ts")]


def run_summary(log: DataFrame, log_file: str, order: list[str], scorer=number_scorer, count_blank: bool = False) -> DataFrame:
    """One row per run of consecutive rows of one model in each log file, with trials, score and times.

    With ``count_blank`` a row without an answer is a wrong trial, and ends a run of another model; without it such rows
    are not there.

    Each range of the ordered rows is read once and gives one partial row per run in it; these are what is stored. Only
    the first and the last of a range can go on in another one, so only they (two rows per range) are merged further.
    """
    if count_blank:
        verdict = F.when(is_blank(F.col("answer")), F.lit(False)).otherwise(scorer(F.col("answer"), F.col("target")))
        log = log.withColumn("ok", verdict)
    else:
        log = scored_rows(log, scorer)
    slim = log.select(log_file, *order, "model", "ok", "start_ts", "end_ts")
    ranged = slim.repartitionByRange(log_file, *order).sortWithinPartitions(log_file, *order)
    columns = ranged.select(F.col(log_file).alias("_file"), F.col("model").alias("_model"), "ok", "start_ts", "end_ts")
    file_type, model_type, _, start_type, end_type = (t for _, t in columns.dtypes)
    schema = (
        f"part int, place long, is_last boolean, file {file_type}, model {model_type}, trials long, hits long, "
        f"start_time {start_type}, end_time {end_type}"
    )
    partials = stored(columns.mapInArrow(_run_partials, schema), "run-partials")
    at_border = (F.col("place") == 0) | F.col("is_last")
    in_order = Window.orderBy("part", "place")  # two rows per range
    key = F.struct("file", "model")
    goes_on = (F.col("place") == 0) & F.coalesce(key == F.lag(key).over(in_order), F.lit(False))
    border = partials.where(at_border).withColumn("_new", (~goes_on).cast("long"))
    border = border.withColumn("_run", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = border.groupBy("_run", "file", "model").agg(
        F.sum("trials").alias("trials"), F.sum("hits").alias("hits"), F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"), F.min_by("part", F.struct("part", "place")).alias("part"),
        F.min_by("place", F.struct("part", "place")).alias("place"),
    )
    runs = partials.where(~at_border).drop("is_last").unionByName(merged.drop("_run"))
    return runs.select(
        F.col("file").alias(log_file), "model", "trials", (F.col("hits") / F.when(F.col("trials") > 0, F.col("trials"))).alias("score"),
        F.lit("number_scorer").alias("scorer"), "start_time", "end_time",
        F.struct("part", "place").alias("run_no"),
    )


def _run_partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal file and model of a sorted range; one that crosses batches is held back."""
    part, place, held = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = [table.column(c).combine_chunks() for c in ("_file", "_model")]
        starts = np.concatenate([[True], _differs(keys[0]) | _differs(keys[1])])
        first = pa.array(np.flatnonzero(starts))
        rows = pa.table({
            "run": np.cumsum(starts) - 1, "ok": table.column("ok"), "hit": pc.cast(table.column("ok"), pa.int64()),
            "start": table.column("start_ts"), "end": table.column("end_ts"),
        })
        # a run's rows follow each other, and groups come in the order of their first row
        sums = rows.group_by("run", use_threads=False).aggregate([("ok", "count"), ("hit", "sum"), ("start", "min"), ("end", "max")])
        made = pa.table({
            "file": keys[0].take(first), "model": keys[1].take(first), "trials": sums["ok_count"],
            "hits": pc.fill_null(sums["hit_sum"], 0), "start_time": sums["start_min"], "end_time": sums["end_max"],
        })
        if held is not None:
            made = _join_ends(held, made)
        held = made.slice(made.num_rows - 1)
        if made.num_rows > 1:
            yield from _placed(made.slice(0, made.num_rows - 1), part, place, False)
            place += made.num_rows - 1
    if held is not None:
        yield from _placed(held, part, place, True)


def _differs(values: pa.Array) -> np.ndarray:
    """Where a value is not the one before; nulls are equal."""
    after, before = values.slice(1), values.slice(0, len(values) - 1)
    same = pc.fill_null(pc.equal(after, before), False)
    both = pc.and_(pc.is_null(after), pc.is_null(before))
    return ~pc.or_(same, both).to_numpy(zero_copy_only=False)


def _join_ends(held: pa.Table, made: pa.Table) -> pa.Table:
    """The held run in front, as one row with the first of ``made`` where their keys are equal."""
    a, b = held.to_pylist()[0], made.slice(0, 1).to_pylist()[0]
    if (a["file"], a["model"]) != (b["file"], b["model"]):
        return pa.concat_tables([held, made])
    pick = lambda f, c: f([x for x in (a[c], b[c]) if x is not None], default=None)
    one = a | {
        "trials": a["trials"] + b["trials"], "hits": a["hits"] + b["hits"], "start_time": pick(min, "start_time"),
        "end_time": pick(max, "end_time"),
    }
    return pa.concat_tables([pa.Table.from_pylist([one], schema=made.schema), made.slice(1)])


def _placed(runs: pa.Table, part: int, place: int, is_last: bool) -> Iterator[pa.RecordBatch]:
    n = runs.num_rows
    front = {
        "part": pa.array(np.full(n, part, np.int32)), "place": pa.array(np.arange(place, place + n)), "is_last": pa.array([is_last] * n),
    }
    yield from pa.table(front | {c: runs[c] for c in runs.column_names}).combine_chunks().to_batches()


def render_conversations(turns: DataFrame, conversation: str, order: str, content: str, out: str = "shown") -> DataFrame:
    """The last content of a conversation of more than two messages, else its contents with a blank line between.

    Only the first, the last and the count are needed, so no message list is gathered, however long it is.
    """
    ends = turns.groupBy(conversation).agg(
        F.count("*").alias("n_messages"), F.min_by(content, order).alias("_first"), F.max_by(content, order).alias("_last")
    )
    pair = F.concat("_first", F.lit("\n\n"), "_last")
    shown = F.when(F.col("n_messages") == 2, pair).otherwise(F.col("_last"))
    return ends.select(conversation, "n_messages", shown.alias(out))


def first_wins(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The first row per key, as a partial aggregate."""
    return _one(df, key, order, F.min_by)


def last_wins(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The last row per key."""
    return _one(df, key, order, F.max_by)


def _one(df: DataFrame, key: str, order: Column | str, pick) -> DataFrame:
    place = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(pick(F.struct(*rest), place).alias("_best"))
    return best.select(key, *[F.col("_best")[c].alias(c) for c in rest])
