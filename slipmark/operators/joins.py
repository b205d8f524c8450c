"""Joins between questions, responses and earlier results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmark.sources.scratch import stored

#: So many distinct keys are sent to all tasks.
FEW_KEYS = 10_000


def one_per_key(df: DataFrame, on: list[str], latest: list[str] | None = None) -> DataFrame:
    """One row for each key: the last by ``latest``, or where that is not given the greatest of its other values."""
    rest = [c for c in df.columns if c not in on]
    if not rest:
        return df.distinct()
    best = df.groupBy(*on).agg(F.max_by(F.struct(*rest), F.struct(*(latest or rest))).alias("_best"))
    return best.select(*on, *[F.col("_best")[c].alias(c) for c in rest])


def align_responses(inputs: DataFrame, responses: DataFrame, on: list[str], latest: list[str] | None = None) -> DataFrame:
    """Bring responses to their inputs, the last one where there are several; an input without any keeps nulls."""
    return inputs.join(one_per_key(responses, on, latest), on, "left")


def matched_sets(sets: DataFrame, key: str, names: list[str], value: str = "text", name: str = "perturbation") -> DataFrame:
    """Keys present in every named set, with their values in the order of ``names``.

    One pass with a partial aggregate instead of a chain of joins.
    """
    picked = [F.max(F.when(F.col(name) == n, F.col(value))).alias(f"_v{i}") for i, n in enumerate(names)]
    present = reduce(lambda a, b: a & b, [F.col(f"_v{i}").isNotNull() for i in range(len(names))])
    wide = sets.where(F.col(name).isin(names)).groupBy(key).agg(*picked)
    return wide.where(present).select(key, F.array(*[F.col(f"_v{i}") for i in range(len(names))]).alias("texts"))


def skip_completed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def cached_logprobs(requests: DataFrame, cache: DataFrame, compute, key: list[str], latest: list[str] | None = None) -> DataFrame:
    """Known values for (input, target), computed ones for the rest; each distinct request is computed once.

    ``cache`` holds the key and ``logprob``, and the columns of ``latest`` that tell which of several entries counts;
    ``compute`` maps the missing distinct requests to the same columns.
    """
    wanted = requests.dropDuplicates(key)
    # only entries of a request are aggregated
    asked = cache.select(*dict.fromkeys([*key, "logprob", *(latest or [])])).join(wanted.select(*key), key, "left_semi")
    cache = one_per_key(asked, key, latest)
    known = wanted.select(*key).join(cache.select(*key, "logprob"), key, "inner")
    missing = wanted.join(cache.select(*key), key, "left_anti")
    values = known.withColumn("cached", F.lit(True)).unionByName(
        compute(missing).select(*key, "logprob").withColumn("cached", F.lit(False))
    )
    return requests.select("request_id", *key).join(values, key, "left")


def pair_by_position(questions: DataFrame, targets: DataFrame, order: str, check: bool = True) -> DataFrame:
    """Pair two lists by position; lists of different length, or with a position that only one has, are an error."""
    if check:
        counts = questions.select(F.count("*").alias("q")).crossJoin(targets.select(F.count("*").alias("t"))).first()
        if counts.q != counts.t:
            raise ValueError(f"{counts.q} questions but {counts.t} targets")
        sides = [questions.select(order), targets.select(order)]
        for a, b in (sides, sides[::-1]):
            lone = a.join(b, order, "left_anti").first()
            if lone is not None:
                raise ValueError(f"position {lone[0]} is in one list only")
    return questions.join(targets, order)


def mark_sample(log: DataFrame, sample: DataFrame, key: str, out: str = "in_sample") -> DataFrame:
    """Flag the rows of a stored sample."""
    flags = sample.select(key).withColumn(out, F.lit(True))
    return log.join(flags, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def keep_sample(log: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    return log.join(sample.select(key), key, "left_semi")


def prefer_annotated(annotated: DataFrame, plain: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the annotated rows, or the plain rows where there is no annotated one.

    A few keys (models, styles, log files) stand for all rows, so the plain rows are not shuffled by them; only many keys are.
    """
    known = stored(annotated.select(*keys).distinct(), "annotated-keys")
    if known.count() <= FEW_KEYS:
        known = F.broadcast(known)
    return annotated.unionByName(plain.join(known, keys, "left_anti"), allowMissingColumns=True)


def failures(df: DataFrame, key: str, outcomes: Column, reason: Column) -> DataFrame:
    """Keys without a valid result, and why. ``df`` should be a stored table, as it is read for both branches."""
    return df.where(F.coalesce(F.size(outcomes), F.lit(0)) == 0).select(key, reason.alias("reason"))
