"""Selection by rank against sorted lists, and its plans."""

import random

import pytest
from pyspark.sql import functions as F

from slipmark.operators import paging, selection

SMALL = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, 0 if v is None else v) for v in r[:2]))


@pytest.fixture(params=["direct", "narrowed"])
def sizes(request, monkeypatch):
    if request.param == "narrowed":
        monkeypatch.setattr(selection, "DIRECT", 40)
        monkeypatch.setattr(selection, "SAMPLE", 60)


def test_ranks_of_two_columns_with_nulls(spark, sizes):
    draw = random.Random(1)
    rows = [(draw.choice([None, "a", "b", "ü", "z"]), i if draw.random() < 0.95 else None, draw.random()) for i in range(1000)]
    rows = list({r[:2]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "a string, b long, c double").repartition(5)
    expected = ordered(rows)
    for start, end in [(0, 10), (7, None), (len(rows) // 2, len(rows) // 2 + 3), (len(rows) - 1, None), (0, 0), (5, 5), (len(rows), None), (3, 10**9)]:
        got = [tuple(r) for r in selection.between_ranks(df, ["a", "b"], start, end).collect()]
        assert ordered(got) == expected[start:end], (start, end)


def test_equal_keys_give_the_right_number(spark, sizes):
    rows = [(k, i) for i, k in enumerate([0] * 3 + [1] * 400 + [2] * 5 + [None] * 50 + list(range(10, 60)))]
    df = spark.createDataFrame(rows, "k long, i long").repartition(4)
    keys = sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    for start, end in [(0, 20), (20, 60), (40, 300), (100, 110), (0, 453), (453, 458), (450, None), (0, 506), (49, 51)]:
        got = selection.between_ranks(df, ["k"], start, end).collect()
        assert len({r.i for r in got}) == len(got)
        assert sorted((r.k for r in got), key=lambda k: (k is not None, k or 0)) == keys[start:end], (start, end)


def test_key_at(spark, sizes):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"))
    hashes = sorted(r.h for r in df.collect())
    for rank in (0, 1, 250, 499):
        assert selection.key_at(df, ["h"], rank) == ((hashes[rank],), 0)
    assert selection.key_at(df, ["h"], 500) is None
    assert selection.key_at(df.limit(0), ["h"], 0) is None


def test_pages_and_samples_write_and_sort_nothing(spark, monkeypatch):
    """A page is a filter of the table; no copy of it is written on the way."""
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **b: pytest.fail("a table was written"))
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    for page in (paging.skip_limit(orders, ["o_orderkey"], 20, 30), paging.draw_sample(orders, "o_orderkey", 30)):
        assert page.count() == 30
        shown = page._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in shown and "Sort" not in shown and "Window" not in shown


def test_the_first_column_bounds_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    page = paging.skip_limit(spark.read.parquet(str(tmp_path / "t")), ["id", "s"], 100, 50)
    assert page.count() == 50
    shown = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,100)" in shown


def test_runs_across_ranges_and_batches(spark):
    """Runs from partial rows: any number of ranges, small Arrow batches, null files and models, verdicts that are null."""
    from slipmark.operators.aggregates import run_summary

    draw = random.Random(2)
    rows, i = [], 0
    while i < 1200:
        name, model, n = draw.choice([None, "a", "b"]), draw.choice([None, "m", "n"]), draw.choice([1, 2, 3, 200])
        for _ in range(n):
            rows.append((name, i, model, draw.choice(["1", "2", "x"]), draw.choice(["1", "no number"]), f"2024-01-{1 + i % 28:02d}", draw.choice([None, "z", "y"])))
            i += 1
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    expected, last = [], object()
    for name, _, model, answer, target, start, end in rows:
        if (name, model) != last:
            expected.append([name, model, 0, 0, start, end])
            last = (name, model)
        run = expected[-1]
        if target == "1":
            run[2], run[3] = run[2] + 1, run[3] + (answer == "1")
        run[4] = min(run[4], start)
        run[5] = max((x for x in (run[5], end) if x is not None), default=None)
    want = sorted(((f, m, n, hits / n if n else None, s, e) for f, m, n, hits, s, e in expected), key=repr)
    schema = "log_file string, id long, model string, answer string, target string, start_ts string, end_ts string"
    keys = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for ranges, batch in (("1", "7"), ("5", "64"), ("40", "3"), ("7", "10000")):
            for k, v in zip(keys, (ranges, batch, "false"), strict=True):
                spark.conf.set(k, v)
            df = spark.createDataFrame(rows, schema).repartition(6)
            got = run_summary(df, "log_file", ["id"]).collect()
            assert sorted(((r.log_file, r.model, r.trials, r.score, r.start_time, r.end_time) for r in got), key=repr) == want
            assert len({tuple(r.run_no) for r in got}) == len(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_run_summary_stores_runs_and_not_rows(spark, monkeypatch):
    from slipmark.operators import aggregates, ordering

    counts = []
    for module in (aggregates, ordering):
        def counted(df, name="table", keep=module.stored):
            out = keep(df, name)
            counts.append((out.count(), out.columns))
            return out

        monkeypatch.setattr(module, "stored", counted)
    rows = [("f", i, "m" if i < 700 else "n", "1", "1", "s", "e") for i in range(1000)]
    df = spark.createDataFrame(rows, "log_file string, id long, model string, answer string, target string, start_ts string, end_ts string")
    assert sorted(r.trials for r in aggregates.run_summary(df, "log_file", ["id"]).collect()) == [300, 700]
    assert len(counts) == 1 and counts[0][0] < 40
    aggregates.chunk_summary(df, ["id"]).collect()
    assert counts[1][1] == ["ok", "start_ts", "end_ts", "_part", "_pos"]
