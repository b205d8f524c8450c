"""Run names and model lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmark.functions import fixed


def clean_model_name(model: Column) -> Column:
    return F.translate(model, "./", "--")


def run_name(
    datafile: Column, position: Column, perturbation: Column, letter_perturbation: Column, model: Column
) -> Column:
    """``{datafile}_adjusted_position-{p}_perturbation-{x}[_letter_perturbation-{y}]_{model}.json``."""
    letters = F.when(letter_perturbation.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("_letter_perturbation-"), letter_perturbation)
    )
    return F.concat(
        datafile, F.lit("_adjusted_position-"), position, F.lit("_perturbation-"), perturbation, letters,
        F.lit("_"), clean_model_name(model), F.lit(".json"),
    )


def parse_run_name(name: Column) -> dict[str, Column]:
    """The parts of a run name; a part that is missing is null."""
    found = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return {
        "datafile": found("^(.*)_adjusted_"),
        "position": found("_adjusted_position-([^_]+)"),
        "perturbation": found("_position-[^_]+_perturbation-([^_]+)"),
        "letter_perturbation": found("_letter_perturbation-([^_]+)"),
        "model_file": found(r"_([^_]+)\.json$"),
    }


def error_type_of(position: Column) -> Column:
    pairs = [F.lit(x) for kv in fixed.ERROR_TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), position)


def base_model_name(model: Column) -> Column:
    """The ``gpt-…`` part of a name, else the last path part up to its first hyphen."""
    gpt = F.nullif(F.regexp_extract(model, rf"gpt-[^{fixed.BLANK_CLASS}:]+", 0), F.lit(""))
    return F.coalesce(gpt, F.substring_index(F.substring_index(model, "/", -1), "-", 1))


def provider(model: Column) -> Column:
    return (
        F.when(model.isin(fixed.TOGETHER_MODELS), F.lit("together"))
        .when(model.isin(fixed.ANTHROPIC_MODELS), F.lit("anthropic"))
        .otherwise(F.lit("openai"))
    )


def limit_family(model: Column) -> Column:
    """Which entry of the limit table applies when batches are built."""
    return (
        F.when(F.contains(model, F.lit("gpt-4")), F.lit("gpt-4"))
        .when(base_model_name(model).isin(fixed.CHAT_MODELS), F.lit("chat"))
        .otherwise(F.lit("text"))
    )


def rate_limits(spark: SparkSession) -> DataFrame:
    """The limit table (one row per family, four rows)."""
    rows = [(k, r, t) for k, (r, t) in fixed.RATE_LIMITS.items()]
    return spark.createDataFrame(rows, "family string, requests_per_minute long, tokens_per_minute long")


def with_provider(df: DataFrame, model: str = "model") -> DataFrame:
    """Add provider, limits and chat flag. The limit table has four fixed rows, so it is broadcast."""
    limits = F.broadcast(rate_limits(df.sparkSession))
    named = df.withColumn("provider", provider(F.col(model))).withColumn("family", limit_family(F.col(model)))
    return named.join(limits, "family", "left").withColumn("is_chat", F.col("family") != "text")
