"""Properties and comparisons with plain brute force on small fixtures."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slipmark.functions import noise, numbers, text
from slipmark.operators import aggregates, containment, ordering, paging
from slipmark.queries import views as V

SMALL = "/root/testdata/sf0.001"


def brute_batches(costs, limit, own):
    batch, total, before = -1, None, 0
    out = []
    for c in costs:
        if total is None or total + (c if own else before) >= limit:
            batch, total = batch + 1, 0
        total, before = total + c, c
        out.append(batch)
    return out


def _batch_rows(hot, least):
    """Rows of which most are in one shard; some costs are above the limit."""
    rng = np.random.default_rng(3)
    return [(("hot" if hot(i) else f"s{i % 8}"), i, int(rng.integers(least, 40 if i % 50 else 400))) for i in range(3000)]


def _check_batches(spark, rows, own, **how):
    df = spark.createDataFrame(rows, "shard string, id long, cost long")
    got = paging.token_budget_batches(df, "shard", ["id"], F.col("cost"), 150, own_cost=own, **how).toPandas()
    assert len(got) == len(rows)
    for shard, part in pd.DataFrame(rows, columns=["shard", "id", "cost"]).groupby("shard", dropna=False):
        mine = got[got["shard"].isna() if pd.isna(shard) else got["shard"] == shard].sort_values("id")["batch"].tolist()
        assert mine == brute_batches(part.sort_values("id")["cost"].fillna(0), 150, own)


@pytest.mark.parametrize("own", [False, True])
def test_token_budget_chunks_agree_with_one_scan(spark, own):
    _check_batches(spark, _batch_rows(lambda i: i % 4, 1), own, chunk_rows=37)


@pytest.mark.parametrize("own, fan, chunk_rows", [(False, 2, 11), (True, 3, 7), (False, 5, 2)])
def test_token_budget_tree_of_any_shape(spark, own, fan, chunk_rows):
    """All rows in one null shard, or with costs of zero and null; chunks shorter than a batch."""
    rows = [(None, i, c) for _, i, c in _batch_rows(lambda i: True, 0)][:600]
    rows = [(s, i, None if i % 31 == 0 else 0 if 200 < i < 260 else c) for s, i, c in rows] + [("one", 10_000, 7)]
    _check_batches(spark, rows, own, chunk_rows=chunk_rows, fan=fan)


def test_step_maps_compose():
    """A composed map gives what its parts give one after the other, for every open cost."""
    rng = random.Random(8)
    for own in (False, True):
        for _ in range(300):
            parts = [[rng.choice([0, 1, 2, 5, 9, 30]) for _ in range(rng.randint(1, 6))] for _ in range(3)]
            maps = [paging._chunk_map(np.array(p, np.int64), 12, own) for p in parts]
            left = paging._compose(paging._compose(maps[0], maps[1], 12, own), maps[2], 12, own)
            right = paging._compose(maps[0], paging._compose(maps[1], maps[2], 12, own), 12, own)
            for tokens, before in [(paging._NONE_OPEN, 0), *[(t, b) for t in range(0, 45) for b in (0, 1, 9, 30)]]:
                at = (tokens, before, 0)
                for m in maps:
                    at = paging._follow(m, *at, 12, own)
                assert paging._follow(left, tokens, before, 0, 12, own) == paging._follow(right, tokens, before, 0, 12, own) == at


def test_containment_agrees_with_nested_loop(spark):
    rng = random.Random(5)
    words = ["box", "pen", "row", "Let's", "12", "3", "é", "has", "the", "of"]
    logged = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    logged += logged[:40] * 3 + ["a\rb", ""]
    asked = ["", "a b", "ab", " ab ", "\r", "zz", "x" * 40]
    for _ in range(400):
        t = rng.choice(logged)
        a = rng.randint(0, len(t))
        asked.append(t[a : a + rng.choice([1, 2, 5, 9, 15, 16, 20, 30, 31, 32, 47, 64, 90])])
        asked.append("".join(rng.choice("boxpen 123") for _ in range(rng.choice([3, 10, 18, 40]))))
    q = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id int, question string")
    log = spark.createDataFrame([(t,) for t in logged], "question string")
    got = {r.id for r in containment.drop_contained(q, log).collect()}
    clean = [t.replace("\r", "") for t in logged]
    want = {i for i, a in enumerate(asked) if not any(a.replace("\r", "").strip() in t for t in clean)}
    assert got == want


def test_templated_questions_give_as_many_candidates_as_hits(spark, monkeypatch):
    """All questions and texts share long common parts; pairs grow with the texts, not with questions times texts."""
    common = "A box of many pens stands in the long hall beside the old red door, and nobody counts "
    counts = []
    keep = containment.stored

    def counted(df, name="table"):
        out = keep(df, name)
        if name == "containment-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(containment, "stored", counted)
    for n in (100, 200):
        tail = lambda i: f"the {i:05d} pens of lot {i * 7919 % 99991:05d} today, or so they say in the shop"
        log = spark.createDataFrame([(f"Q{i}. {common}{tail(i)} at last",) for i in range(n)], "question string")
        asked = spark.createDataFrame([(i, f"{common}{tail(i) if i % 2 else tail(i + 100_000)}") for i in range(n)], "id long, question string")
        assert sorted(r.id for r in containment.drop_contained(asked, log).collect()) == list(range(0, n, 2))
    assert counts[1] <= 2 * counts[0] + 10 and counts[1] <= 2 * 200


def test_containment_stores_one_row_for_each_question(spark, monkeypatch):
    """Questions of all lengths, also shorter ones than any piece: no row per offset, piece or substring is stored."""
    rng = random.Random(9)
    line = lambda: "".join(rng.choice("abcdefgh 0123") for _ in range(200))
    logged = [line() for _ in range(150)] + ["é" * 40 + "ü" * 9, "x"]
    cuts = [(t := rng.choice(logged))[(a := rng.randint(0, len(t))) : a + rng.randint(0, 150)] for _ in range(300)]
    asked = cuts + [c[::-1] for c in cuts] + ["é" * 3, "éü", "ü" * 10, "y", "x" * 300]
    rows, keep = {}, containment.stored

    def counted(df, name="table"):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(containment, "stored", counted)
    q = spark.createDataFrame(list(enumerate(asked)), "id int, question string")
    got = {r.id for r in containment.drop_contained(q, spark.createDataFrame([(t,) for t in logged], "question string")).collect()}
    assert got == {i for i, a in enumerate(asked) if not any(a.strip() in t for t in logged)}
    assert all(n <= len(asked) + len(logged) for name, n in rows.items() if name != "containment-pairs")
    assert rows["containment-pairs"] <= 2 * len(asked) * 12  # short questions stand in many texts


def test_numbering_and_runs_do_not_depend_on_partitions(spark):
    rows = [(f"f{i % 3}", i, "m" + str((i // 7) % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "log_file string, id long, model string").repartition(13)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "8", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            numbered = ordering.number_rows(df, ["log_file", "id"]).orderBy("row_no").collect()
            assert [r.row_no for r in numbered] == list(range(500))
            assert [(r.log_file, r.id) for r in numbered] == sorted((r[0], r[1]) for r in rows)
            runs = ordering.run_ids(df, ["log_file", "id"], F.struct("log_file", "model"))
            results.append([r.run_no for r in runs.orderBy("log_file", "id").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected, last, n = [], None, -1
    for f, _, m in sorted(rows):
        n += (f, m) != last
        last = (f, m)
        expected.append(n)
    assert results == [expected] * 3


def test_pages_are_slices_of_the_ordered_rows(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1009)
    ordered = sorted(range(1000), key=lambda i: i * 7919 % 1009)
    assert [r.id for r in paging.skip_limit(df, ["k"], 13, 400).orderBy("k").collect()] == ordered[13:413]
    assert paging.skip_limit(df, ["k"], 13, -1).count() == 987


def test_number_outputs_share_all_but_the_change(spark):
    df = V.responses_text(spark, SMALL)
    made = numbers.number_intervention(F.col("row_id"), F.col("text"), "copy", "add1_add101", remove_steps=False)
    rows = df.select("text", text.reasoning_boundary(F.col("text")).alias("b"), made.alias("m")).where(F.size("m") > 0)
    for r in rows.limit(300).collect():
        one, two = r.m[0].text, r.m[1].text
        same = 0
        while same < min(len(one), len(two)) and one[same] == two[same]:
            same += 1
        head = one[:same].rstrip("0123456789,.-")
        assert r.text[r.b :].strip().startswith(head)
        assert one != two


def test_letter_noise_keeps_everything_but_letters(spark):
    docs = V.table(spark, SMALL, "documents").where("text <> ''")
    made = noise.letter_noise(F.col("doc_id").cast("string"), F.col("text"), "typo5_typo10")
    start = text.reasoning_boundary(F.col("text"))
    rest = F.btrim(F.substring("text", start + 1, F.length("text")))
    rows = docs.select(rest.alias("t"), made.alias("m")).where(F.size("m") > 0).collect()
    assert len(rows) > 100
    for r in rows:
        base = r.t.strip()
        five, ten = r.m[0].text, r.m[1].text
        assert len(five) == len(ten) == len(base)
        changed = lambda t: {i for i, (a, b) in enumerate(zip(base, t)) if a != b}
        assert all(base[i].isalpha() and five[i] in "abcdefghijklmnopqrstuvwxyz" for i in changed(five))
        assert len(changed(five)) <= 6 and len(changed(ten)) <= 10


def test_draws_do_not_depend_on_partitions(spark):
    df = V.responses_text(spark, SMALL)
    made = numbers.number_intervention(F.col("row_id"), F.col("text"), "copy", "random")["text"].alias("v")
    one = sorted((r.row_id, tuple(r.v)) for r in df.repartition(1).select("row_id", made).collect())
    many = sorted((r.row_id, tuple(r.v)) for r in df.repartition(64).select("row_id", made).collect())
    assert one == many


def test_first_and_last_of_one_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("q"), "id",
        (F.col("id") * 31 % 5003).alias("v"))
    first = aggregates.first_wins(df, "q", "id").where("q = 'hot'").first()
    last = aggregates.last_wins(df, "q", "id").where("q = 'hot'").first()
    assert (first.id, last.id) == (0, 4998)


def test_running_sums(spark):
    from slipmark.functions.lets import running_sums

    rng = random.Random(2)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(x,) for x in lists], "v array<int>")
    got = [r.s for r in df.select(running_sums(F.col("v")).alias("s")).collect()]
    assert got == [list(np.cumsum(x)) for x in lists]


def test_long_texts(spark):
    """Work per row stays near linear: 20,000 numbers and 200,000 letters in one text."""
    many = " ".join(f"{i % 977} apples" for i in range(20_000))
    df = spark.createDataFrame([("a", many)], "k string, t string")
    got = df.select(
        F.size(numbers.number_tokens(F.col("t"))).alias("n"),
        numbers.number_tokens(F.col("t"))[19_999]["end"].alias("end"),
        numbers.number_intervention(F.col("k"), F.col("t"), "copy", "add1")[0]["text"].alias("x"),
        noise.letter_noise(F.col("k"), F.col("t"), "typo10")[0]["text"].alias("y"),
    ).first()
    assert got.n == 20_000 and got.end == len(many) - len(" apples")
    assert many.startswith(got.x.rsplit(" ", 1)[0]) and len(got.y) == len(many)


def test_whole_numbers_are_changed_by_native_columns(spark):
    """Short whole numbers give what exact sums give, and a query's drawn change is computed in one place."""
    from slipmark.queries.numbers import perturb_value

    cases = [(n, c) for n in ("1", "9", "10", "1,000", "12,345", "999,999,999,999,999", "999999999999999", "1000000000000000") for c in (-101, -10, -1, 1, 5, 10**15, 2**62)]
    rows = [(f"{n}{dot}", c) for n, c in cases for dot in ("", ".")]
    df = spark.createDataFrame(rows, "n string, c long")
    shown = [numbers.perturb_value(F.col("n"), F.col("c"), pad).alias(f"p{int(pad)}") for pad in (True, False)]
    for r in df.select("n", "c", *shown).collect():
        total = int(r.n.replace(",", "").rstrip(".")) + r.c
        want = f"{total:,}" if "," in r.n else str(total)
        assert (r.p1, r.p0) == (want + "." * r.n.endswith("."), want), (r.n, r.c)
    plan = perturb_value(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    projects = [line for line in plan.splitlines() if "md5(" in line]
    assert len(projects) == 1 and projects[0].count("md5(") <= 3
