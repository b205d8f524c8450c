"""The batch steps of ASCII texts against the native columns, and that the queries use them."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from slipmark.functions import ascii, noise, numbers
from slipmark.sources import logs

PIECES = [
    "1. ", " 2. ", " 3.", " 1.\n", "10. ", "4.\t", " Let's think step by step.", " Let's think step by step.1. ", "1,234", "1,2345", "12,34,567", "1.2.3",
    "1.5,234", "0", "007", ".", ",", "5.", "1,200.50", "1200.5", " pens ", "and", "\x00", "\x1c", "9" * 400, "1.", "2.0 ", "2", " 2 ", "-7", "a1b", "@",
]


def _texts(spark):
    rng = random.Random(5)
    rows = [("k" + str(i) if i % 17 else None, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows += [("n", None), ("w", "drei ٣٤ und 5. 1. So 5"), ("u", "Grüße 3 an 3. Let's think step by step. 1. 3 und 4, 4")]
    return spark.createDataFrame(rows, "k string, t string").repartition(3)


def _both(spark, monkeypatch, make):
    """The rows of a column as it is, and with native columns alone."""
    df = _texts(spark).withColumn("id", F.xxhash64("k", "t"))
    rows = lambda: sorted(df.select("id", make().alias("v")).collect(), key=repr)
    fast = rows()
    kinds = {
        "mask_step_numbers": "string", "number_tokens": "array<struct<idx:int,start:int,`end`:int,text:string,value:double>>",
        "number_occurrences": "array<struct<first_start:int,value:double,n:int,starts:array<int>>>", "letter_noise": "array<string>",
        "chosen_number": "struct<start:int,from1:int,to1:int,from2:int,to2:int,head:string,middle:string>",
    }
    for name, kind in kinds.items():
        monkeypatch.setattr(ascii, name, lambda *_, kind=kind: F.lit(None).cast(kind))
    each = "array<struct<idx:int,number:string,partner_idx:int>>"
    monkeypatch.setattr(
        ascii, "candidates", lambda _, positions, __: F.lit(None).cast(f"struct<{','.join(f'`{p}`:{each}' for p in positions)}>"))
    assert len(fast) == 603
    return fast, rows()


def test_tokens_occurrences_and_masks_are_those_of_the_native_columns(spark, monkeypatch):
    t, start = F.col("t"), F.when(F.length("t") % 3 == 0, F.length("t") / 2).otherwise(0).cast("int")
    fast, native = _both(spark, monkeypatch, lambda: F.struct(
        numbers.number_tokens(t).alias("a"), numbers.number_occurrences(t).alias("b"), numbers.mask_step_numbers(t, start).alias("c"),
        numbers.mask_step_numbers(t, numbers.reasoning_boundary(t)).alias("d")))
    assert fast == native


def test_candidates_are_those_of_the_native_columns(spark, monkeypatch):
    t = F.col("t")
    fast, native = _both(spark, monkeypatch, lambda: F.struct(
        numbers.candidates_by_position(t).alias("a"), numbers.select_candidates(t, "propcalc", remove_steps=False).alias("b")))
    assert fast == native


@pytest.mark.parametrize(("position", "matched"), [("copy", None), ("propcalc", None), ("propcalc", noise.matched_noise(9))])
def test_changed_texts_are_those_of_the_native_columns(spark, monkeypatch, position, matched):
    k, t = F.col("k"), F.col("t")
    fast, native = _both(
        spark, monkeypatch, lambda: numbers.number_intervention(k, t, position, "random", noise=matched, reasons=True))
    assert fast == native


def test_letter_noise_is_that_of_the_native_columns(spark, monkeypatch):
    k, t = F.col("k"), F.col("t")
    fast, native = _both(spark, monkeypatch, lambda: noise.letter_noise(k, t, "typo5_typo20"))
    assert fast == native


def test_ascii_texts_are_searched_in_batches(spark, capsys):
    for made in (numbers.candidates_by_position(F.col("t")), noise.letter_noise(F.col("k"), F.col("t"), "typo5")):
        _texts(spark).select(made.alias("v")).explain()
        assert "ArrowEvalPython" in capsys.readouterr().out


def test_log_files_have_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "FILE_ROWS", 7)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    rows = spark.range(50).select(F.col("id").cast("string").alias("a"), F.lit('x\n"y"').alias("b")).coalesce(1)
    logs.write_csv(rows, path)
    back = spark.read.options(**logs.CSV_OPTIONS).csv(path)
    assert back.orderBy(F.col("a").cast("int")).collect() == rows.orderBy(F.col("a").cast("int")).collect()
    assert max(r["count"] for r in back.groupBy(F.input_file_name()).count().collect()) == 7
