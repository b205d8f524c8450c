"""Quality rules as a bitmask ledger: each rule is evaluated once, policies and ablations are bit operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmark.functions.lets import indexes, let

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Name of each rule, in the order of its bit. A set bit means that the text fails the rule.
RULES = ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words")
#: Versioned policies: the rules whose failure rejects a text. v1 is the base; later versions add rules.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words"),
}


def policy_mask(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def _repeated_words(words: Column) -> Column:
    """Words that stand in a window of three words which the array holds twice or more.

    Windows are sorted by hash with their places; those equal to a neighbour are repeated; in order of place, each adds
    the words that the one before has not covered.
    """

    def sort(x):
        window = lambda i: F.struct(
            F.xxhash64(F.get(x["w"], i), F.get(x["w"], i + 1), F.get(x["w"], i + 2)).alias("h"), i.alias("i")
        )
        return let({"s": F.sort_array(F.transform(indexes(F.size(x["w"]) - 2), window))}, find)

    def find(x):
        s = x["s"]
        found = F.filter(s, lambda e, i: F.coalesce((i > 0) & (e["h"] == F.get(s, i - 1)["h"]), F.lit(False))
                         | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(found, lambda e: e["i"])),
            start,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    return let({"w": words}, sort)


def measurements(text: Column) -> Column:
    """A struct of what the rules look at; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))

    def measure(x):
        lines = F.filter(F.split(x["t"], "\n"), lambda line: line.rlike(WORD))
        return F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.translate(x["t"], _BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(x["t"]) - F.length(F.translate(x["t"], _SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let({"l": lines}, lambda y: F.struct(
                F.size(y["l"]).cast("long").alias("n_lines"),
                (F.size(y["l"]) - F.size(F.array_distinct(y["l"]))).cast("long").alias("n_dup_lines"))).alias("lines"),
            _repeated_words(x["w"]).alias("n_repeat_words"),
        )

    return let({"t": text, "w": F.array_remove(F.split(text, SPACE), "")}, measure)


def _failures() -> Column:
    """Failure bits from the measurement columns."""
    tests = {
        "few_words": F.col("n_words") < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "many_symbols": 5 * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "long_words": F.col("word_chars") > 16 * F.col("n_words"),
    }
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(tests[rule], F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one more column, ``ledger``: measurements and ``bits``, one for each failed rule.

    Row-local and without any shuffle, so groups of any size and repeated rows are no problem; a null or empty text has
    no words and fails ``few_words``. A column of the same name is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "ledger"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], measurements(F.col(f"`{text_col}`").cast("string")).alias("ledger"))
    flat = {
        "n_words": "ledger.n_words", "word_chars": "ledger.word_chars", "n_symbols": "ledger.n_symbols",
        "n_lines": "ledger.lines.n_lines", "n_dup_lines": "ledger.lines.n_dup_lines", "n_repeat_words": "ledger.n_repeat_words",
    }
    shown = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *[F.col(v).alias(k) for k, v in flat.items()])
    done = shown.select("row", F.struct(*flat, _failures().alias("bits")).alias("ledger"))
    return done.select("row.*", "ledger")


def passes(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def passing(docs: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` whose text passes the policy, whatever the columns are called."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = ledger(docs.select(whole, F.col(f"`{text_col}`").alias("text")))
    return rows.where(passes(F.col("ledger.bits"), policy)).select("whole.*")


def ablations(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: texts that fail it, and texts that only it rejects. No rule is evaluated again.

    The ledger is first counted by bits, at most 2 ** rules rows; a table without rows gives zeros.
    """
    mask = policy_mask(policy)
    bits = F.col("ledger.bits").bitwiseAND(F.lit(mask).cast("long"))
    counts = ledger_rows.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    sums = counts.agg(
        *[total(F.col("bits").bitwiseAND(F.lit(1 << RULES.index(r)).cast("long")) != 0).alias(f"f_{r}") for r in POLICIES[policy]],
        *[total(F.col("bits") == (1 << RULES.index(r))).alias(f"o_{r}") for r in POLICIES[policy]],
    )
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed"), F.col(f"o_{r}").alias("only")) for r in POLICIES[policy]])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = "v2") -> DataFrame:
    """One row for each input row: id, measurements, bits, ``base_failed`` (policy v1) and ``kept``.

    A null or empty text has zeros and fails; null ids and repeated rows are kept; other columns are ignored.
    """
    rows = ledger(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text")
    base = ~passes(F.col("bits"), "v1")
    return rows.select("doc_id", "ledger.*").withColumns(
        {"base_failed": base, "kept": ~base & passes(F.col("bits"), policy)}
    )
