"""Cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from conftest import one
from slipmark.functions import identity, logprobs, messages, noise, numbers, specs, text

REASONING = "Q: 2 and 3\n\nA: Let's think step by step. 2 + 3 = 5. So 5."


@pytest.mark.parametrize("answer, target, expected", [
    ("x. Therefore, the answer (arabic numerals) is $1,000.", "1000", True),
    ("5 The answer (arabic numerals) is 7", "7", True),
    (" 8-3=5", "5", False),
    ("a-3", "-3", True),
    ("007", "7", False),
    ("00", "0", True),
    ("007.5", "7.5", True),
    ("5.0", "5", True),
    ("٣", "3", False),
    ("none", "3", False),
    ("5", "five", None),
    (None, "5", False),
])
def test_number_scorer(spark, answer, target, expected):
    got = one(spark, text.number_scorer(F.col("a"), F.col("t")), a=answer, t=target)
    assert got is expected


def test_format_prompt(spark):
    once = one(spark, text.format_prompt(F.col("q"), "sbs"), q="How many?")
    assert once == "Q: How many?\n\nA: Let's think step by step."
    assert one(spark, text.format_prompt(F.col("q"), "sbs"), q=once) == once
    assert one(spark, text.format_prompt(F.col("q"), "sbs recovery"), q="How many?").endswith("fix any mistakes.")
    assert one(spark, text.format_prompt(F.col("q"), "zeroshot"), q="a") == "a The answer (arabic numerals) is"
    assert one(spark, text.format_prompt(F.col("q"), "qa"), q="Q: Q: a") == "Q: a\n\nA:"
    assert one(spark, text.format_prompt(F.col("q"), ""), q="a") == "a"


def test_targets_and_words(spark):
    assert one(spark, text.extract_target(F.col("a")), a="a b #### 1,234 ") == "1234"
    assert one(spark, text.extract_target(F.col("a"), True), a="a b #### 1,234 ") == "1,234"
    assert one(spark, text.is_numeric_word(text.first_word(F.col("a"))), a=" 9 (apples)") is True
    assert one(spark, text.is_numeric_word(text.first_word(F.col("a"))), a="1/2 (pie)") is False
    assert one(spark, text.question_key(F.col("a")), a="no question") is None
    assert one(spark, text.question_key(F.col("a")), a="Q: x\n\nA: Let's think step by step. y") == "x"


@pytest.mark.parametrize("before, after", [
    (" 1. a 2. b 4. c", " @. a @. b 4. c"),
    ("1. a 2. b", "@. a @. b"),
    ("a 2. b", "a 2. b"),
    ("a 6. 1. 2. x", "a 6. @. @. x"),
    ("x 2. y 1. z 2. w", "x 2. y @. z @. w"),
    ("x\n1.\ty", "x @. y"),
    (" 01. a 1.5 b $1. c", " 01. a 1.5 b $1. c"),
])
def test_mask_step_numbers(spark, before, after):
    assert one(spark, numbers.mask_step_numbers(F.col("t"), F.lit(0)), t=before) == after


def test_mask_starts_at_boundary(spark):
    asked = "Q: 1. a Let's think step by step. 1. b 2. c"
    got = one(spark, numbers.mask_step_numbers(F.col("t"), text.reasoning_boundary(F.col("t"))), t=asked)
    assert got == "Q: 1. a Let's think step by step. @. b @. c"
    tight = "Q: 1. a Let's think step by step.1. b 2. c"
    got = one(spark, numbers.mask_step_numbers(F.col("t"), text.reasoning_boundary(F.col("t"))), t=tight)
    assert got == "Q: 1. a Let's think step by step.@. b @. c"


def test_number_tokens(spark):
    got = one(spark, numbers.number_tokens(F.col("t")), t="1,234.50. So 6.")
    assert [(t.start, t.end, t.text, t.value) for t in got] == [(0, 8, "1,234.50", 1234.5), (13, 15, "6.", 6.0)]
    assert [t.text for t in one(spark, numbers.number_tokens(F.col("t")), t="1,2345 a")] == ["1,234", "5"]
    assert one(spark, numbers.number_tokens(F.col("t")), t="none") == []
    assert [t.value for t in one(spark, numbers.number_tokens(F.col("t")), t="é ٣٤ 5")] == [34.0, 5.0]


@pytest.mark.parametrize("number, change, padded, plain", [
    ("1,999", 1, "2,000", "2,000"),
    ("05", 1, "06", "6"),
    ("3.50", 1, "4.5", "4.5"),
    ("3.00", 1, "4.0", "4.0"),
    ("6.", 1, "7.", "7"),
    ("05.", 1, "06.", "6"),
    ("0.50", 1, "01.5", "1.5"),
    ("0.50", -3, "-2.5", "-2.5"),
    ("1", -3, "-2", "-2"),
    ("001", -3, "0-2", "-2"),
    ("0", 1, None, None),
    ("0.", 1, None, None),
    ("0.0", 1, "1.0", "1.0"),
    ("12345678901234567890", 1, "12345678901234567891", "12345678901234567891"),
])
def test_perturb_value(spark, number, change, padded, plain):
    assert one(spark, numbers.perturb_value(F.col("n"), F.lit(change)), n=number) == padded
    assert one(spark, numbers.perturb_value(F.col("n"), F.lit(change), False), n=number) == plain


@pytest.mark.parametrize("position, spec, allowed", [
    ("copy", "add1", [["3"], ["2 + 4"], ["2 + 3 = 5. So 6."]]),
    ("calc", "add1", [["2 + 3 = 6."]]),
    ("propcalc", "add1_add101", [["2 + 3 = 6. So 6.", "2 + 3 = 106. So 106."]]),
])
def test_number_intervention(spark, position, spec, allowed):
    keys = spark.createDataFrame([(str(i), REASONING) for i in range(40)], "k string, t string")
    made = numbers.number_intervention(F.col("k"), F.col("t"), position, spec)
    got = {tuple(r.v) for r in keys.select(made["text"].alias("v")).collect()}
    assert got == {tuple(a) for a in allowed}


def test_number_intervention_outcomes(spark):
    made = lambda **o: numbers.number_intervention(F.col("k"), F.col("t"), **o)
    assert one(spark, made(position="copy"), k="a", t="no number") == []
    assert one(spark, made(position="any", perturbation="add1"), k="a", t="only 0 here") == []
    assert one(spark, made(position="any", perturbation="add1"), k="a", t="cost 1,234.50 only") == []
    assert [r.text for r in one(spark, made(position="any", perturbation="add1_add2"), k="a", t="")] == ["", ""]
    other = one(spark, made(position="any", perturbation="add1"), k="a", t="we have ٣ left")
    assert other == []


def test_bad_specs_are_rejected():
    for spec in ("transpose", "add0", "add", "foo"):
        with pytest.raises(ValueError):
            specs.number_parts(spec)
    with pytest.raises(ValueError):
        specs.number_parts("random", 0, 0)
    for spec in ("random", "typo", "add1"):
        with pytest.raises(ValueError):
            specs.letter_parts(spec)


def test_letter_noise_needs_letters(spark):
    assert one(spark, noise.letter_noise(F.col("k"), F.col("t"), "typo3"), k="a", t="abc 1") == []
    got = one(spark, noise.letter_noise(F.col("k"), F.col("t"), "typo3"), k="a", t="abcd 1")
    assert len(got) == 1 and len(got[0].text) == 6 and got[0].text[0] == "a"


def test_messages(spark):
    got = one(spark, messages.build_messages(F.col("q")), q="Q: x\n\nA: y A: z")
    assert [(m.role, m.content) for m in got] == [("user", "Q: x"), ("assistant", "A: y  z")]
    got = one(spark, messages.build_messages(F.col("q"), "s", "p", False), q="a A: b")
    assert [(m.role, m.content) for m in got] == [("system", "s"), ("user", "a A: b"), ("user", "p")]
    assert one(spark, messages.render_messages(messages.build_messages(F.col("q"))), q="a A: b") == "a\n\nA: b"


def test_models(spark):
    base = lambda m: one(spark, identity.base_model_name(F.col("m")), m=m)
    assert base("meta-llama/Llama-3-70b-chat-hf") == "Llama"
    assert base("ft:gpt-3.5-turbo-0613:me::1") == "gpt-3.5-turbo-0613"
    assert one(spark, identity.limit_family(F.col("m")), m="gpt-3.5-turbo") == "chat"
    assert one(spark, identity.limit_family(F.col("m")), m="claude-3-opus-20240229") == "text"


def test_target_logprob(spark):
    tokens = F.array(*[F.lit(t) for t in ["The", " answer", " is", ":", " ", "12", "x", "3", "<|endoftext|>", "3"]])
    values = F.array(*[F.lit(-float(i)) for i in range(10)])
    got = one(spark, logprobs.target_logprob(tokens, values, F.lit("The answer is:"), F.lit("123")), x="")
    assert (got.logprob, got.answer_text, got.n_tokens) == (-12.0, "123", 2)
    got = one(spark, logprobs.target_logprob(tokens, values, F.lit("unrelated"), F.lit("123")), x="")
    assert (got.logprob, got.n_tokens) == (0.0, 0)
