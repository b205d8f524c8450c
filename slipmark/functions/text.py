"""Prompt building, answer scoring and small text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmark.functions import fixed
from slipmark.functions.lets import string_of, strip


def has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def assemble_question(body: Column, ask: Column) -> Column:
    return F.concat(body, F.lit(" "), ask)


def extract_target(answer: Column, keep_commas: bool = False) -> Column:
    """The text after the last ``####``, trimmed; commas go unless ``keep_commas`` (used when re-scoring)."""
    last = F.substring_index(answer, "####", -1)
    if keep_commas:
        return F.when(has(answer, "####"), strip(last)).otherwise(answer)
    return F.replace(strip(last), F.lit(","), F.lit(""))


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, f"[^{fixed.BLANK_CLASS}]+", 0)


def is_numeric_word(word: Column) -> Column:
    return word.rlike(r"^\p{N}+$")


def format_prompt(question: Column, style: Column | str) -> Column:
    """The prompt for a question, by substrings of the style."""
    style = string_of(style)
    step_style = has(style, "sbs")
    open_q = F.when(has(question, "Q:") | has(question, "Question:"), F.lit("")).otherwise(F.lit("Q: "))
    close_a = F.when(has(question, "\nA:") | has(question, "\nAnswer:"), F.lit("")).otherwise(F.lit("\n\nA:"))
    framed = F.replace(F.concat(open_q, question, close_a), F.lit("Q: Q:"), F.lit("Q:"))
    text = F.when(has(style, "qa") | step_style, framed).otherwise(question)
    guided = has(question, fixed.STEP_SENTENCE) | has(question, fixed.CAREFUL_SENTENCE)
    sentence = (
        F.when(~step_style | guided, F.lit(""))
        .when(has(style, "recovery"), F.lit(fixed.CAREFUL_SENTENCE))
        .otherwise(F.lit(fixed.STEP_SENTENCE))
    )
    direct = F.when(has(style, "zeroshot"), F.lit(" " + fixed.DIRECT_SUFFIX)).otherwise(F.lit(""))
    return F.concat(text, sentence, direct)


def perturbed_prompt(question: Column, style: Column | str, reasoning: Column) -> Column:
    with_reasoning = F.concat(format_prompt(question, style), F.lit(" "), reasoning)
    return F.when(F.coalesce(reasoning, F.lit("")) != "", with_reasoning).otherwise(question)


def base_style(style: Column) -> Column:
    """The style before ``system:``."""
    return F.when(has(style, "system:"), strip(F.split_part(style, F.lit("system:"), F.lit(1)))).otherwise(style)


def system_prompt(style: Column) -> Column:
    return F.when(has(style, "system:"), strip(F.split_part(style, F.lit("system:"), F.lit(2)))).otherwise(F.lit(""))


def full_query(prompt: Column, response: Column) -> Column:
    """Prompt and response, null when either is missing (a blank prompt counts as missing)."""
    return F.when(prompt != "", F.concat(prompt, F.lit(" "), response))


def answer_extraction_prompt(prompt: Column, response: Column) -> Column:
    return F.concat(full_query(prompt, response), F.lit(fixed.ANSWER_SUFFIX))


def stage_count(style: Column) -> Column:
    one = (style == "") | has(style, "fewshot") | has(style, "direct")
    return F.when(one, F.lit(1)).otherwise(F.lit(2))


def style_label(style: Column, temperature: Column) -> Column:
    """The recorded style: the temperature is noted when it is not zero."""
    shown = F.concat(style, F.lit(" temp="), temperature.cast("string"))
    return F.when(F.coalesce(temperature, F.lit(0.0)) != 0, shown).otherwise(style)


def question_key(prompt: Column) -> Column:
    """The question inside a prompt, null when there is no ``Q: `` before the reasoning."""
    head = strip(F.split_part(prompt, F.lit("A: Let's think"), F.lit(1)))
    return F.when(has(head, "Q: "), F.split_part(head, F.lit("Q: "), F.lit(2)))


def prompt_reasoning(prompt: Column, full_prompt: Column) -> Column:
    """The reasoning inside a prompt, or the full prompt when the prompt holds none."""
    inside = F.split_part(prompt, F.lit(fixed.STEP_SENTENCE), F.lit(2))
    return F.when(has(prompt, fixed.STEP_SENTENCE), inside).otherwise(F.coalesce(full_prompt, F.lit("")))


def qa_wrap(prompt: Column) -> Column:
    return F.when(prompt != "", F.concat(F.lit("Q: "), prompt, F.lit("\nA:"))).otherwise(prompt)


def logprob_prompt(prior: Column, query: Column, style: Column, target: Column) -> Column:
    explanation = F.when(has(style, "sbs"), prior).otherwise(F.concat(query, F.lit(fixed.LOGPROB_SUFFIX)))
    return F.concat(explanation, F.lit(" "), target)


def is_blank(answer: Column) -> Column:
    return answer.isNull() | (answer == "")


def normalize_question(question: Column) -> Column:
    return strip(F.replace(question, F.lit("\r"), F.lit("")))


def reasoning_boundary(text: Column) -> Column:
    """Offset just after the first plain step-by-step sentence, else 0."""
    at = F.instr(text, fixed.STEP_SENTENCE)
    return F.when(at > 0, at - 1 + len(fixed.STEP_SENTENCE)).otherwise(F.lit(0))


def numeric_target(target: Column) -> Column:
    """The target as a double, null when it is not a plain number (an integer with leading zeros is not one)."""
    text = strip(target.cast("string"))
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & ~text.rlike(r"^[+-]?0+[1-9][0-9]*$")
    return F.when(plain, text.try_cast("double"))


def _same_integer(a: Column, b: Column) -> Column:
    """Whether two integer literals of any length are equal, by their digits."""
    def shown(x: Column) -> Column:
        digits = F.regexp_replace(x, r"^[+-]?0*(?=[0-9])", "")
        return F.when(F.startswith(x, F.lit("-")) & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)

    return shown(a) == shown(b)


def number_scorer(answer: Column, target: Column) -> Column:
    """Whether the first number of the answer equals the target; null when the target is not a number.

    Integers are equal by their digits, whatever their length; doubles are compared where one side has a point or exponent.
    """
    tail = (
        F.when(has(answer, fixed.ANSWER_SUFFIX), F.substring_index(answer, fixed.ANSWER_SUFFIX, -1))
        .when(has(answer, fixed.DIRECT_SUFFIX), F.substring_index(answer, fixed.DIRECT_SUFFIX, -1))
        .otherwise(answer)
    )
    first = F.regexp_extract(F.replace(tail, F.lit(","), F.lit("")), r"-?\p{Nd}+\.?\p{Nd}*", 0)
    readable = first.rlike(r"^-?[0-9]+\.?[0-9]*$") & ~first.rlike(r"^-?0+[1-9][0-9]*$")
    wanted = strip(target.cast("string"))
    # a double holds every integer of up to 15 digits; the lengths are tested first, so that short numbers cost no more
    wide = (F.greatest(F.length(first), F.length(wanted)) > 15) & first.rlike("^-?[0-9]+$") & wanted.rlike("^[+-]?[0-9]+$")
    digits = F.when(~wanted.rlike(r"^[+-]?0+[1-9][0-9]*$"), readable & _same_integer(first, wanted))
    # an unreadable answer is a number that no target is, so the target's number is computed once
    value = F.coalesce(F.when(readable, first.try_cast("double")), F.lit(float("nan")))
    return F.when(wide, digits).otherwise(value == numeric_target(target))


def exact_scorer(answer: Column, target: Column) -> Column:
    """A second scorer: the trimmed answer equals the target text."""
    return strip(answer) == strip(target.cast("string"))


def token_count(text: Column) -> Column:
    """Words and single signs; the default cost measure of token-budget batches."""
    return F.regexp_count(text, F.lit(rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{fixed.BLANK_CLASS}]")).cast("long")
