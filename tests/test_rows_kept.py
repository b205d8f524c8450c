"""No call loses or multiplies rows."""

import pytest
from pyspark.sql import functions as F

from slipmark.operators.aggregates import run_summary
from slipmark.operators.joins import align_responses, cached_logprobs, pair_by_position
from slipmark.plans.evaluate import evaluate_dataset, rescore_log
from slipmark.sources import scratch


def test_reruns_by_all_order_columns_and_reasons(spark):
    rows = [("f", 0, i, f"q{i}", "1/2" if i == 5 else str(i)) for i in range(6)]
    asked = spark.createDataFrame(rows, "src_file string, src_block int, src_seq int, question string, target string")

    def run(df, attempt):
        answer = F.when((F.col("src_seq") % 2 == 1) | ((F.col("src_seq") == 2) & (F.lit(attempt) == 1)), F.lit(" it is 1"))
        return df.withColumns({"response": answer, "start_ts": F.current_timestamp(), "end_ts": F.current_timestamp()})

    got = evaluate_dataset(asked, run, "m", "sbs", "test", ["src_file", "src_block", "src_seq"], reruns=1)
    assert got.rows.count() == 6
    reasons = {r.question: r.reason for r in got.failures.collect()}
    assert reasons == {"q0": "no answer", "q4": "no answer", "q5": "target can't be read"}


def test_one_response_for_a_question(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, question string")
    told = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "question string, answer string, at int")
    assert {(r.row_id, r.answer) for r in align_responses(inputs, told, ["question"], ["at"]).collect()} == {(1, "new"), (2, None)}
    requests = spark.createDataFrame([(1, "a"), (2, "c")], "request_id long, q string")
    cache = spark.createDataFrame([("a", -1.0), ("a", -1.0)], "q string, logprob double")
    got = cached_logprobs(requests, cache, lambda m: m.select("q", F.lit(-9.0).alias("logprob")), ["q"])
    assert sorted((r.request_id, r.logprob) for r in got.collect()) == [(1, -1.0), (2, -9.0)]


def test_positions_must_match(spark):
    left, right = spark.range(3).toDF("n"), spark.createDataFrame([(0,), (1,), (9,)], "n long")
    with pytest.raises(ValueError):
        pair_by_position(left, right, "n")
    assert pair_by_position(left, spark.range(3).toDF("n"), "n").count() == 3


def log(spark, rows):
    return spark.createDataFrame(
        [("f.csv", i, m, "sbs", a, "7", None) for i, (m, a) in enumerate(rows)],
        "log_file string, row_id int, model string, style string, answer string, target string, error_type string",
    ).withColumns({"start_ts": F.current_timestamp(), "end_ts": F.current_timestamp()})


def test_skip_is_before_the_filter(spark):
    rows = log(spark, [("other", "7"), ("other", "7"), ("m", "7"), ("m", "8")])
    assert [r.trials for r in rescore_log(rows, "test", "m", "sbs", "log_file", ["row_id"], skip=2).collect()] == [2]


def test_blank_rows_end_a_run(spark):
    rows = log(spark, [("a", "7"), ("b", None), ("a", "7")])
    assert run_summary(rows, "log_file", ["row_id"]).count() == 1
    assert run_summary(rows, "log_file", ["row_id"], count_blank=True).count() == 3


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://somewhere:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(Session())


def test_a_run_of_scratch_tables_can_be_cleared(spark):
    import os

    scratch.stored(spark.range(3), "some")
    where = scratch.run_folder(spark).removeprefix("file://")
    assert any(name.startswith("some-") for name in os.listdir(where))
    kept = os.path.join(os.path.dirname(where), "not-of-this-run")
    os.makedirs(kept, exist_ok=True)
    assert scratch.clear_run(spark) and not os.path.exists(where) and os.path.exists(kept)
    assert not scratch.clear_run(spark)
    assert scratch.stored(spark.range(3), "again").count() == 3


def test_blank_answers_are_wrong_trials_when_a_log_is_scored_again(spark):
    rows = log(spark, [("m", "7"), ("m", None), ("m", ""), ("m", "7")])
    score = lambda **more: [(r.trials, r.score) for r in rescore_log(rows, "test", "m", "sbs", "log_file", ["row_id"], **more).collect()]
    assert score() == [(4, 0.5)] and score(limit=2) == [(2, 0.5)]
    assert score(count_blank=False) == [(2, 1.0)]


def test_earlier_rows_are_kept_where_all_parts_have_the_question(spark):
    from slipmark.plans.tasksets import build_letter_taskset, earlier_sets

    old = [("q0", "1", "typo1", "a"), ("q0", "1", "typo2", "b"), ("q0", "1", "typo2", "a"), ("q1", "2", "typo1", "c"), ("q0", "1", "typo9", "z"), ("q2", None, "typo1", "d"), ("q2", None, "typo2", "e")]
    earlier = spark.createDataFrame(old, "question string, target string, perturbation string, text string")
    held = {(r.question, r.part_no, r.text) for r in earlier_sets(earlier, ["typo1", "typo2"]).collect()}
    assert held == {("q0", 0, "a"), ("q0", 1, "b"), ("q2", 0, "d"), ("q2", 1, "e")}
    rows = spark.createDataFrame([("q0", "some words here", "1", 0), ("q1", "other words here", "2", 1), ("q3", "x", "3", 2), (None, "some words here", "4", 3)],
                                 "question string, reasoning string, target string, row_id int")
    made = build_letter_taskset(rows, "typo1_typo2", earlier=earlier)
    assert sorted((r.question, r.part_no) for r in made.rows.collect()) == [(q, i) for q in ("q0", "q1", "q2") for i in (0, 1)]
    assert {(r.question, r.reason) for r in made.failures.collect()} == {("q3", "too few letters"), (None, "no question in the prompt")}
    assert build_letter_taskset(rows, "typo1_typo2", earlier=earlier.limit(0)).rows.count() == 4


def test_reasons_of_number_changes(spark):
    from slipmark.functions.noise import matched_noise
    from slipmark.functions.numbers import NO_FORM, NO_NUMBER, number_intervention

    df = spark.createDataFrame([("a", "no digits"), ("b", "5 and 5"), ("c", "")], "k string, t string")
    got = lambda **more: {r.k: (len(r.made), r.reason) for r in df.select("k", number_intervention(
        df.k, df.t, "any", "add1", reasons=True, **more).alias("o")).select("k", "o.*").collect()}
    assert got() == {"a": (0, NO_NUMBER), "b": (1, None), "c": (1, None)}
    noisy = got(noise=matched_noise(90))
    assert noisy["a"] == (0, NO_NUMBER) and noisy["b"] == (0, NO_FORM + ", or too few letters")


def test_message_lists_with_a_closing_message(spark):
    from slipmark.plans.generate import generate_from_messages

    df = spark.sql("select 1 as id, array(named_struct('role', 'user', 'content', 'hello')) as messages")
    row = generate_from_messages(df, lambda f: f["messages"].map(lambda m: m[-1]["content"]), "Be brief.").first()
    assert (row.prompt, row.response, len(row.messages)) == ("hello", "Be brief.", 2)


def test_integers_of_any_length_are_compared_by_their_digits(spark):
    from slipmark.functions.text import number_scorer

    big = "9" * 60
    rows = [
        ("9007199254740993", "9007199254740992", False), ("9007199254740993", "9007199254740993", True), (big, big, True),
        (f"is {big}.", big, None), (big, big[:-1] + "8", False), ("-" + big, big, False), (big, "+" + big, True),
        ("5", "5.0", True), ("-0", "0", True), ("1" + "0" * 400, "1" + "0" * 401, False), ("x", big, False), (big, "1/2", None),
    ]
    df = spark.createDataFrame(rows, "answer string, target string, want boolean")
    for r in df.withColumn("ok", number_scorer(df.answer, df.target)).collect():
        if not r.answer.startswith("is"):
            assert r.ok == r.want, r


def test_a_log_with_another_header_is_an_error(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from slipmark.sources import logs

    one = spark.range(3).select(*[F.lit("a").alias(n) for n in logs.LOG_COLUMNS])
    logs.write_csv(one, str(tmp_path / "log"))
    assert logs.read_log(spark, str(tmp_path / "log")).count() == 3
    with pytest.raises(ValueError, match="Error Type"):
        logs.read_log(spark, str(tmp_path / "log"), annotated=True)
    logs.write_csv(one.select(F.lit("b").alias("Note"), "*"), str(tmp_path / "log"))
    with pytest.raises(Exception):
        logs.read_log(spark, str(tmp_path / "log")).collect()


def test_numbers_of_any_length_change(spark):
    from decimal import Decimal, getcontext

    from pyspark.sql import functions as F

    from slipmark.functions.numbers import perturb_value

    getcontext().prec = 300
    wholes = ["9" * 60, "1" + "0" * 60, "1" + "0" * 37, "9" * 37, "9" * 38, "12" * 25, "0" * 50 + "7", "1" + "9" * 40, "5" * 20 + "0" * 20]
    rows = [(w, c, str(int(w) + c)) for w in wholes for c in (1, -1, 101, -101, 10**17, -(10**17))]
    commas = [f"{int(w):,}" for w in wholes if w[0] != "0"]
    rows += [(w, c, f"{int(w.replace(',', '')) + c:,}") for w in commas for c in (1, -101)]

    def plain(d, c):
        shown = format(Decimal(d) + c, "f")
        return shown.rstrip("0") + ("0" if shown.rstrip("0").endswith(".") else "")

    decimals = ["1" * 40 + ".25", "3." + "14" * 30, "0." + "0" * 50 + "1", "2." + "0" * 45, "9" * 45 + "." + "90" * 20]
    rows += [(d, c, plain(d, c)) for d in decimals for c in (1, -1, 101, -101)]
    df = spark.createDataFrame(rows, "n string, c long, want string")
    for r in df.withColumn("got", perturb_value(F.col("n"), F.col("c"), False)).collect():
        assert r.got == r.want, r
