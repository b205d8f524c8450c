"""Replace random letters of a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmark.functions import ascii
from slipmark.functions.draws import SEED, draw, sample_positions
from slipmark.functions.fixed import LETTERS
from slipmark.functions.lets import let, strip
from slipmark.functions.specs import letter_parts
from slipmark.functions.text import reasoning_boundary

BLOCK = 64
# 64 letters with what stands before each; the last piece holds what follows the last letter.
BLOCK_PIECE = rf"(?s)(?:\P{{L}}*+\p{{L}}){{1,{BLOCK}}}|\P{{L}}++"
LETTER_PIECE = r"(?s)\P{L}*+\p{L}"


def letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}")).cast("long")


def letter_places(text: Column, positions: Column) -> Column:
    """Rank and select: for each p of ``positions`` the letter p + 1 (letter 0 is never chosen) and its place in the text, as
    array<struct<letter, at>>; null where the text has no such letter.

    The text is cut once into blocks of 64 letters, whose lengths give where each begins; only a block that holds a
    chosen letter is cut into letters, once, whatever the number of letters chosen in it.
    """

    def places(z):
        begin = lambda b: F.aggregate(F.slice(z["blocks"], F.lit(1), b), F.lit(1), lambda n, piece: n + F.length(piece))
        table = lambda b: F.struct(
            b.alias("b"), begin(b).alias("begin"),
            F.transform(F.regexp_extract_all(F.get(z["blocks"], b), F.lit(LETTER_PIECE), 0), lambda x: F.length(x)).alias("sizes"),
        )
        wanted = F.array_distinct(F.transform(z["letters"], lambda k: F.shiftright(k, 6).cast("int")))
        inside = F.filter(wanted, lambda b: b < F.size(z["blocks"]))
        return let({"letters": z["letters"], "tables": F.transform(inside, table)}, select)

    def select(y):
        def one(k):
            here = F.get(F.filter(y["tables"], lambda t: t["b"] == F.shiftright(k, 6)), F.lit(0))
            i = F.pmod(k, F.lit(BLOCK)).cast("int")
            at = F.aggregate(F.slice(here["sizes"], F.lit(1), i + 1), here["begin"] - 1, lambda n, size: n + size)
            return F.when(F.size(here["sizes"]) > i, F.struct(k.alias("letter"), at.alias("at")))

        return F.transform(y["letters"], one)

    fields = {"letters": F.transform(positions, lambda p: p + 1), "blocks": F.regexp_extract_all(text, F.lit(BLOCK_PIECE), 0)}
    return let(fields, places)


def put_letters(key: Column, text: Column, places: Column, purpose: Column | str, seed: str = SEED) -> Column:
    """The text with a drawn letter at each of ``places``."""

    def put(z, done, p):
        drawn = F.substring(F.lit(LETTERS), (draw(z["key"], z["purpose"], p["letter"], seed) % 26 + 1).cast("int"), F.lit(1))
        return F.when(p.isNotNull(), F.overlay(done, drawn, p["at"], F.lit(1))).otherwise(done)

    fields = {"key": key, "text": text, "places": places, "purpose": purpose if isinstance(purpose, Column) else F.lit(purpose)}
    return let(fields, lambda z: F.aggregate(z["places"], z["text"], lambda done, p: put(z, done, p)))


def replace_letters(key: Column, text: Column, positions: Column, purpose: str, seed: str = SEED) -> Column:
    """Replace letter k by a drawn one where k - 1 is in ``positions``; so letter 0 never changes."""
    return let(
        {"key": key, "text": text, "positions": positions},
        lambda z: put_letters(z["key"], z["text"], letter_places(z["text"], z["positions"]), purpose, seed),
    )


def letter_noise(key: Column, text: Column, perturbation: str = "typo1", seed: str = SEED) -> Column:
    """One noisy text per spec part ``typoN``, over what follows the step-by-step sentence.

    All parts share one draw: a part uses its first N + 1 positions, so a larger N changes at least the same
    letters. Gives array<struct<part_no, perturbation, text>>; empty when there are not more letters than the
    largest N. An empty text passes through.
    """
    parts = letter_parts(perturbation)
    most = max(p.count for p in parts)
    each = F.array(*[
        F.struct(F.lit(i).alias("part_no"), F.lit(p.name).alias("perturbation"), F.lit(p.count).alias("count")) for i, p in enumerate(parts)
    ])

    def noisy(z):
        def of_part(p):
            chosen = F.slice(z["places"], F.lit(1), p["count"] + 1)
            made = put_letters(z["key"], z["rest"], chosen, F.concat(F.lit("letter:"), p["perturbation"]), seed)
            return F.struct(p["part_no"].alias("part_no"), p["perturbation"].alias("perturbation"), strip(made).alias("text"))

        return F.transform(each, of_part)

    none = F.array().cast("array<struct<part_no:int,perturbation:string,text:string>>")
    unchanged = F.transform(each, lambda p: F.struct(p["part_no"], p["perturbation"], F.lit("").alias("text")))

    def drawn(y):
        positions = sample_positions(y["key"], y["n"], most, "letters", seed)
        found = let({"key": y["key"], "rest": y["rest"], "places": letter_places(y["rest"], positions)}, noisy)
        return F.when(y["n"] > most, found).otherwise(none)

    def counted(x):
        rest = F.substring(x["text"], reasoning_boundary(x["text"]) + 1, F.length(x["text"]))
        return let(
            {"key": x["key"], "rest": rest},
            lambda y: let({"key": y["key"], "rest": y["rest"], "n": letter_count(y["rest"])}, drawn),
        )

    texts = ascii.letter_noise(key, text, [(p.name, p.count) for p in parts], seed)
    found = F.transform(texts, lambda t, i: F.struct(i.alias("part_no"), F.get(each, i)["perturbation"].alias("perturbation"), t.alias("text")))
    other = F.when(texts.isNotNull(), found).otherwise(let({"key": key, "text": text}, counted))
    return F.when(text == "", unchanged).otherwise(other).cast("array<struct<part_no:int,perturbation:string,text:string>>")


@dataclass(frozen=True)
class matched_noise:
    """Letter noise for the outputs of a number change: the same positions in every output text.

    Positions are drawn over the letters of the first text; null when it has no more than ``count`` letters.
    """

    count: int
    seed: str = SEED

    def __call__(self, key: Column, texts: Column) -> Column:
        def changed(z):
            return F.when(
                z["n"] > self.count,
                let(
                    {
                        "key": z["key"],
                        "texts": z["texts"],
                        "positions": sample_positions(z["key"], z["n"], self.count, "letters", self.seed),
                    },
                    lambda y: F.transform(
                        y["texts"], lambda t: replace_letters(y["key"], t, y["positions"], "letter:all", self.seed)
                    ),
                ),
            )

        first = lambda w: F.coalesce(F.get(w["texts"], F.lit(0)), F.lit(""))
        return let(
            {"key": key, "texts": texts},
            lambda w: let({"key": w["key"], "texts": w["texts"], "n": letter_count(first(w))}, changed),
        )
