"""target_logprob on Arrow batches: null and odd rows, and a query that sends no token list through the JVM."""

from pyspark.sql import functions as F

from slipmark.functions import logprobs

SMALL = "/root/testdata/sf0.001"


def test_odd_rows(spark):
    end = "<|endoftext|>"
    rows = [
        (0, ["a", " is:", " ", "1", None, "\x1c", "2", "3"], [-1.0, -2.0, -3.0, -4.0, -5.0, -6.0, -7.0], "a is:\n", "123", (None, "1\x1c23", 4)),
        (1, None, [1.0], "a", "1", None),
        (2, ["a"], None, "a", "1", None),
        (3, ["a", "1"], [-1.0, -2.0], None, "1", (0.0, "", 0)),
        (4, ["a", "1"], [-1.0, -2.0], "a", None, (0.0, "", 0)),
        (5, [], [], "a", "1", (0.0, "", 0)),
        (6, ["é", "　é", "1", end, "2"], [-1.0, -2.0, -3.0, -4.0, -5.0], "é　é", "12", (-3.0, "1", 1)),
        (7, [" ", "1"], [-1.0, None], "", "1", (None, "1", 1)),
        (8, [end, "a", "1"], [-1.0, -2.0, -3.0], "a", "1", (0.0, "", 0)),
        (9, ["x", "is", "1", "is", "1"], [-1.0, -2.0, -3.0, -4.0, -5.0], "is 1is", "1", (0.0, "", 0)),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "i int, t array<string>, p array<double>, e string, g string").repartition(3)
    got = {r.i: r.m and tuple(r.m) for r in df.select("i", logprobs.target_logprob(F.col("t"), F.col("p"), F.col("e"), F.col("g")).alias("m")).collect()}
    assert got == {r[0]: r[5] for r in rows}


def test_no_token_list_passes_the_jvm(spark):
    from slipmark.queries.aggregates import target_logprob

    plan = target_logprob(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan and "lambda" not in plan
