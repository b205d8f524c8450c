"""Row filters of response logs and problem sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmark.functions import fixed
from slipmark.functions.text import first_word, is_blank, is_numeric_word, number_scorer


def numeric_answers(df: DataFrame, answer: str, target: str) -> DataFrame:
    """Rows whose first answer word is all numeric characters; that word becomes the target."""
    word = first_word(F.col(answer))
    return df.where(is_numeric_word(word)).withColumn(target, word)


def taskset_error_type(taskset: str) -> str | None:
    """The error type of a task set's name, None for original task sets."""
    found = re.search(r"position-([^_]*)", taskset)
    return fixed.ERROR_TYPES.get(found.group(1)) if found else None


def log_row_filter(taskset: str, model: str, style: str, strict: bool = False) -> Column:
    """Rows of one model and style; an annotated row must have the error type of the task set.

    Rows without annotation pass, unless ``strict``. Plain comparisons only, so that they reach the scan.
    """
    wanted = taskset_error_type(taskset)
    keep = F.col("model").isNotNull() & F.col("style").isNotNull() & (F.col("model") == model) & (F.col("style") == style)
    if wanted is None:
        return keep
    fits = F.col("error_type") == wanted
    return keep & (fits if strict else (F.col("error_type").isNull() | fits))


def correct_only(log: DataFrame, model: str, style: str, scorer=number_scorer) -> DataFrame:
    """Rows of one model and style whose answer the scorer accepts; the cheap conditions come first."""
    return log.where((F.col("model") == model) & (F.col("style") == style)).where(
        ~is_blank(F.col("answer")) & scorer(F.col("answer"), F.col("target"))
    )
