"""Scorers and skip predicates as arguments."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmark.functions.text import exact_scorer, number_scorer

Scorer = Callable[[Column, Column], Column]

SCORERS: dict[str, Scorer] = {"number_scorer": number_scorer, "exact_scorer": exact_scorer}


def scorer_named(name: str) -> Scorer:
    try:
        return SCORERS[name]
    except KeyError:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(SCORERS)}") from None


def python_scorer(fn: Callable[[str, str], bool]) -> Scorer:
    """A scorer from a Python function of response and target, in Arrow batches."""

    @F.pandas_udf("boolean")
    def score(responses: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else bool(fn(r, t)) for r, t in zip(responses, targets)], dtype=object)

    return lambda response, target: score(response, target)


def python_skip(fn: Callable[[str], bool]) -> Callable[[Column], Column]:
    """A skip predicate from a Python function of the question."""

    @F.pandas_udf("boolean")
    def skip(questions: pd.Series) -> pd.Series:
        return questions.map(lambda q: q is None or bool(fn(q))).astype(bool)

    return lambda question: skip(question)
