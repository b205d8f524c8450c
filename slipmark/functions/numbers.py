"""Find the numbers of a text, choose one (or a pair) of an error position, and change it.

Everything is one row-local expression, with no explode and no shuffle. Work per row is n log n in its numbers. The numbers of
ASCII texts are searched on Arrow batches (``ascii``), those of other texts by native columns.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmark.functions import ascii, fixed
from slipmark.functions.draws import SEED, draw
from slipmark.functions.lets import indexes, let, running_sums, strip
from slipmark.functions.specs import NumberPart, number_parts
from slipmark.functions.text import reasoning_boundary

POSITIONS = ("any", "copy", "calc", "propcalc")

# A number: thousands commas and a decimal part (or a bare final period) are allowed, signs are not.
NUMBER = r"[0-9]++(?:,[0-9]{3})*+(?:\.[0-9]*+)?+"
# A number with everything since the number before it. Such pieces tile the text; the last one, without a number,
# takes what follows the last number, so that the search stays linear on texts with few digits.
PIECE = rf"(?s)[^0-9]*+({NUMBER})|[^0-9]++"


def _mark_piece(digit: str, blank: str) -> str:
    """The same pieces with a group that is set where the number is a step marker: ``N.`` between blanks."""
    number = NUMBER.replace("0-9", digit)
    mark = rf"(?<![^{blank}])([1-9][0-9]{{0,{len(str(fixed.MAX_STEP_NUMBER)) - 1}}})\.(?=[{blank}])"
    return rf"(?s)[^{digit}]*+(?:{mark}|{number})|[^{digit}]++"


# For ASCII texts plain classes do; in others any script's digits make a number (but not a marker).
MARK_PIECE = _mark_piece("0-9", r"\t-\r\x1c-\x20")
WIDE_MARK_PIECE = _mark_piece(r"\p{Nd}", fixed.BLANK_CLASS)

_OTHER_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_OTHER_VALUES = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _mark_pieces(text: Column, group: int) -> Column:
    extract = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), group)
    return F.when(_is_ascii(text), extract(MARK_PIECE)).otherwise(extract(WIDE_MARK_PIECE))


def ascii_digits(text: Column) -> Column:
    """Digits of other scripts as 0-9, length kept; texts without such digits pass untouched."""
    mapped = F.translate(text, "".join(_OTHER_DIGITS), _OTHER_VALUES)
    plain = _is_ascii(text) | ~text.rlike(r"[\p{Nd}&&[^0-9]]")
    return F.when(plain, text).otherwise(mapped)


def _masked_marks(text: Column, start: Column, skip: Column) -> Column:
    """Which numbers of the text (by index) are step markers to mask, as array<int>.

    Marker N is looked for in the whole text, and the search ends at the first N without one. It is masked at its
    first place after the first place of marker N - 1; for N = 1, at its first place from the boundary on. ``skip``
    is the count of numbers before the boundary.
    """

    def fold(z):
        # by N and place, so that each N comes with its places in order
        marks = F.sort_array(
            F.array_compact(
                F.transform(
                    z["marks"],
                    lambda m, i: F.when(
                        m != "", F.struct(m.cast("int").alias("n"), i.cast("int").alias("i"))
                    ),
                )
            )
        )

        def step(state, mark):
            again = mark["n"] == state["n"]
            next_n = mark["n"] == state["n"] + 1
            after = F.when(next_n, state["first"]).otherwise(state["after"])
            edge = next_n & (mark["n"] == 1) & (state["edge"] >= 0)
            hit = (again & ~state["hit"] | next_n) & (mark["i"] > after) & ~edge
            return F.struct(
                F.when(next_n, mark["n"]).otherwise(state["n"]).alias("n"),
                F.when(next_n, mark["i"]).otherwise(state["first"]).alias("first"),
                after.alias("after"),
                F.when(next_n, hit | edge).otherwise(state["hit"] | hit).alias("hit"),
                state["edge"].alias("edge"),
                F.when(edge, F.concat(state["at"], F.array(state["edge"])))
                .when(hit, F.concat(state["at"], F.array(mark["i"])))
                .otherwise(state["at"]).alias("at"),
            )

        # a first marker right at the boundary has no blank before it but stands at the start of its part
        edge = (z["start"] > 0) & F.substring(z["text"], z["start"] + 1, F.lit(3)).rlike(rf"^1\.[{fixed.BLANK_CLASS}]")
        initial = F.struct(
            F.lit(0).alias("n"),
            (z["skip"] - 1).cast("int").alias("first"),
            F.lit(-1).alias("after"),
            F.lit(False).alias("hit"),
            F.when(edge, z["skip"]).otherwise(F.lit(-1)).cast("int").alias("edge"),
            F.array().cast("array<int>").alias("at"),
        )
        folded = F.aggregate(marks, initial, step, lambda s: s["at"])
        return F.when(F.array_contains(z["marks"], "1"), folded).otherwise(F.array().cast("array<int>"))

    # most texts without steps are told apart by a plain search
    marks = F.when(F.contains(text, F.lit("1.")), _mark_pieces(text, 1)).otherwise(F.array().cast("array<string>"))
    return let({"text": text, "start": start, "skip": skip, "marks": marks}, fold)


def _numbers_before(text: Column, start: Column) -> Column:
    """``text`` has ASCII digits only."""
    count = F.regexp_count(F.substring(text, F.lit(1), start), F.lit(NUMBER))
    return F.when(start > 0, count).otherwise(F.lit(0))


def mask_step_numbers(text: Column, boundary: Column) -> Column:
    """The text with the step markers ``1.``, ``2.``, … replaced by ``@`` signs; its length is kept."""

    def masked(z):
        fields = {"text": z["text"], "at": _masked_marks(z["text"], z["start"], z["skip"])}
        return let(fields, lambda y: F.when(F.size(y["at"]) > 0, rebuilt(y)).otherwise(y["text"]))

    def rebuilt(y):
        def piece(p, i):
            size = F.length(p)
            opened = F.when(F.array_contains(y["at"], (i - 1).cast("int")), F.concat(F.lit(" "), F.substring(p, F.lit(2), size)))
            whole = F.coalesce(opened, p)
            width = F.length(F.regexp_extract(p, r"([0-9]+)\.\z", 1))
            head = F.substring(whole, F.lit(1), size - width - 2)
            before = F.when(size > width + 1, F.substring(whole, size - width - 1, F.lit(1))).otherwise(F.lit(""))
            blank = F.when((before != "") & (strip(before) == ""), F.lit(" ")).otherwise(before)
            signs = F.concat(head, blank, F.repeat(F.lit("@"), width), F.lit("."))
            return F.when(F.array_contains(y["at"], i.cast("int")), signs).otherwise(whole)

        return F.array_join(F.transform(_mark_pieces(y["text"], 0), piece), "")

    other = let(
        {"text": text, "start": boundary},
        lambda w: let(
            {
                "text": w["text"],
                "start": w["start"],
                "skip": _numbers_before(ascii_digits(w["text"]), w["start"]),
            },
            masked,
        ),
    )
    return F.coalesce(ascii.mask_step_numbers(text, boundary), other)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), 0)


def _numbers(text: Column) -> Column:
    return F.array_remove(F.regexp_extract_all(text, F.lit(PIECE), 1), "")


def number_value(number: Column) -> Column:
    """The value of a number text as a double: commas off, so that 1,200 = 1200 = 1200.0."""
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def number_tokens(text: Column) -> Column:
    """All numbers in order as array<struct<idx, start, end, text, value>> with 0-based offsets."""
    return F.coalesce(ascii.number_tokens(text), _native_tokens(text))


def _native_tokens(text: Column) -> Column:

    def tokens(z):
        return let(
            {
                "numbers": z["numbers"],
                "ends": running_sums(F.transform(z["pieces"], lambda p: F.length(p))),
            },
            lambda y: F.zip_with(
                y["numbers"],
                F.slice(y["ends"], F.lit(1), F.size(y["numbers"])),
                lambda n, end: F.struct(
                    (end - F.length(n)).alias("start"), end.alias("end"), n.alias("text"), number_value(n).alias("value")
                ),
            ),
        )

    def numbered(t, i):
        return F.struct(
            i.cast("int").alias("idx"), t["start"].alias("start"), t["end"].alias("end"),
            t["text"].alias("text"), t["value"].alias("value"),
        )

    split_up = lambda x: let(
        {
            "pieces": _pieces(x["text"]),
            "numbers": _numbers(x["text"]),
        },
        tokens,
    )
    return F.transform(let({"text": ascii_digits(text)}, split_up), numbered)


def number_occurrences(text: Column) -> Column:
    """Numbers grouped by value, by first place: array<struct<value, n, first_start, starts>>."""

    def groups(z):
        # sorted by value and place, so a group is a run; ``heads`` are the run starts
        return let(
            {
                "s": z["s"],
                "heads": F.filter(
                    indexes(F.size(z["s"])),
                    lambda j: (j == 0) | ~F.get(z["s"], j - 1)["value"].eqNullSafe(F.get(z["s"], j)["value"]),
                ),
            },
            lambda y: F.transform(
                y["heads"],
                lambda j, g: let(
                    {
                        "j": j,
                        "n": F.coalesce(F.get(y["heads"], g + 1), F.size(y["s"])) - j,
                    },
                    lambda x: F.struct(
                        F.get(y["s"], x["j"])["start"].alias("first_start"),
                        F.get(y["s"], x["j"])["value"].alias("value"),
                        x["n"].alias("n"),
                        F.transform(F.slice(y["s"], x["j"] + 1, x["n"]), lambda t: t["start"]).alias("starts"),
                    ),
                ),
            ),
        )

    pairs = F.transform(
        _native_tokens(text), lambda t: F.struct(t["value"].alias("value"), t["start"].alias("start"))
    )
    return F.coalesce(ascii.number_occurrences(text), F.sort_array(let({"s": F.sort_array(pairs)}, groups)))


def _unformattable(number: Column) -> Column:
    """A number with commas and decimals has no changed form; another place is drawn instead."""
    return F.contains(number, F.lit(",")) & number.rlike(r"\.[0-9]")


def _candidate_rows(z: Column, position: str, body) -> Column:
    """Bind the numbers ``s`` and the indexes ``picks`` of the candidates in it.

    Sorted by value then place, the occurrences of a value are neighbours: an entry is a first occurrence when its
    left neighbour has another value, and a repeated one when it has the same. An entry has the value ``v``, the
    index ``i`` among all numbers, the index ``p`` among those not masked, and the text ``t``.
    """

    def entries(x):
        entry = lambda i, p: F.struct(
            number_value(F.get(x["numbers"], i)).alias("v"), i.alias("i"), p.cast("int").alias("p"),
            F.get(x["numbers"], i).alias("t"),
        )
        listed = F.transform(x["live"], entry)
        return listed if position == "any" else F.sort_array(listed)

    same = lambda y, j, k: F.get(y["s"], j)["v"].eqNullSafe(F.get(y["s"], k)["v"])
    repeats = lambda y, j: (j > 0) & same(y, j, j - 1)
    follows = lambda y, j: (j + 1 < F.size(y["s"])) & same(y, j, j + 1)
    keep = {
        "any": lambda y, j: F.lit(True),
        "calc": lambda y, j: ~repeats(y, j),
        "copy": repeats,
        "propcalc": lambda y, j: ~repeats(y, j) & follows(y, j),
    }[position]

    def picks(y):
        usable = lambda j: (
            (F.get(y["s"], j)["i"] >= y["skip"]) & keep(y, j) & ~_unformattable(F.get(y["s"], j)["t"])
        )
        return F.filter(indexes(F.size(y["s"])), usable)

    kept = ("key", "start", "text", "found", "skip")
    carried = lambda row, *more: {f: row[f] for f in (*kept, *more)}
    live = F.array_except(indexes(F.size(z["numbers"])), z["masked"])
    return let(
        {**carried(z), "numbers": z["numbers"], "live": live},
        lambda x: let(
            {**carried(x), "s": entries(x)},
            lambda y: let({**carried(y, "s"), "picks": picks(y)}, body),
        ),
    )


def _split_numbers(key: Column, text: Column, position: str, remove_steps: bool, body) -> Column:
    """The candidates of one position, bound for ``body``."""
    return _with_numbers(key, text, remove_steps, lambda x: _candidate_rows(x, position, body))


def _with_numbers(key: Column, text: Column, remove_steps: bool, body) -> Column:
    """Bind boundary, numbers, the count of numbers before the boundary, and the masked step markers."""
    none = F.array().cast("array<int>")
    fields = lambda row, *names: {f: row[f] for f in ("key", "text", "start", *names)}

    def numbers(y):
        masked = _masked_marks(y["text"], y["start"], y["skip"]) if remove_steps else none
        return let(
            {**fields(y, "found", "skip"), "numbers": _numbers(y["found"]), "masked": masked},
            body,
        )

    return let(
        {"key": key, "text": text},
        lambda w: let(
            {"key": w["key"], "text": w["text"], "start": reasoning_boundary(w["text"]), "found": ascii_digits(w["text"])},
            lambda z: let({**fields(z, "found"), "skip": _numbers_before(z["found"], z["start"])}, numbers),
        ),
    )


def _listed(position: str):
    def listed(y):
        second = lambda j: F.get(y["s"], j + 1)["p"] if position == "propcalc" else F.lit(None).cast("int")
        return F.transform(
            y["picks"],
            lambda j: F.struct(
                F.get(y["s"], j)["p"].alias("idx"), F.get(y["s"], j)["t"].alias("number"), second(j).alias("partner_idx")
            ),
        )

    return listed


def select_candidates(text: Column, position: str, remove_steps: bool = True) -> Column:
    """The candidates of an error position: array<struct<idx, number, partner_idx>> in value order.

    ``idx`` counts the numbers of the whole masked text; ``partner_idx`` is the second place of ``propcalc``.
    """
    found = ascii.candidates(text, (position,), remove_steps)[position]
    return F.coalesce(found, _split_numbers(F.lit(""), text, position, remove_steps, _listed(position)))


def candidates_by_position(text: Column, positions: tuple[str, ...] = POSITIONS, remove_steps: bool = True) -> Column:
    """The candidates of several positions, array<struct<position, c>>: the text's numbers are found once."""
    each = lambda x: F.array(*[F.struct(F.lit(p).alias("position"), _candidate_rows(x, p, _listed(p)).alias("c")) for p in positions])
    found = ascii.candidates(text, positions, remove_steps)
    named = F.array(*[F.struct(F.lit(p).alias("position"), found[p].alias("c")) for p in positions])
    return F.when(found.isNotNull(), named).otherwise(_with_numbers(F.lit(""), text, remove_steps, each))


def part_change(key: Column, part: NumberPart, min_adjust: int, max_adjust: int, seed: str = SEED) -> Column:
    """The total change of one spec part: never zero, uniform over the other possible values."""
    if not part.random:
        return F.lit(part.amount).cast("long")
    skips = min_adjust <= -part.amount <= max_adjust
    choices = max_adjust - min_adjust + (0 if skips else 1)
    drawn = draw(key, f"change:{part.name}", 0, seed) % choices + min_adjust
    if skips:
        drawn = F.when(drawn >= -part.amount, drawn + 1).otherwise(drawn)
    return drawn + part.amount


def _added(digits: Column, change: Column) -> Column:
    """``digits`` + ``change`` as text, for integers of any length: the last 18 digits are added, the rest takes the carry."""
    block = F.lit(10**18).cast("decimal(38,0)")

    def carried(z):
        up = F.concat(F.regexp_replace(z["head"], "[0-9]9*$", ""), (F.regexp_extract(z["head"], "([0-9])9*$", 1).cast("int") + 1).cast("string"),
                      F.regexp_replace(F.regexp_extract(z["head"], "(9*)$", 1), "9", "0"))
        up = F.when(z["head"].rlike("^9+$"), F.concat(F.lit("1"), F.regexp_replace(z["head"], "9", "0"))).otherwise(up)
        down = F.concat(F.regexp_replace(z["head"], "[1-9]0*$", ""), (F.regexp_extract(z["head"], "([1-9])0*$", 1).cast("int") - 1).cast("string"),
                        F.regexp_replace(F.regexp_extract(z["head"], "(0*)$", 1), "0", "9"))
        head = F.when(z["tail"] >= block, up).when(z["tail"] < 0, down).otherwise(z["head"])
        tail = F.when(z["tail"] >= block, z["tail"] - block).when(z["tail"] < 0, z["tail"] + block).otherwise(z["tail"])
        return F.regexp_replace(F.concat(head, F.lpad(tail.cast("decimal(18,0)").cast("string"), 18, "0")), "^0+(?=[0-9])", "")

    def split(z):
        n = F.length(z["digits"])
        tail = F.substring(z["digits"], n - 17, F.lit(18)).cast("decimal(38,0)") + z["change"].cast("decimal(38,0)")
        long = let({"head": F.substring(z["digits"], F.lit(1), n - 18), "tail": tail}, carried)
        short = (z["digits"].try_cast("decimal(38,0)") + z["change"].cast("decimal(38,0)")).cast("string")
        return F.when(n > 36, long).otherwise(short)

    return let({"digits": F.regexp_replace(digits, "^0+(?=[0-9])", ""), "change": change}, split)


def _added_decimal(digits: Column, change: Column) -> Column:
    """The same for digits with a point: the places stay, or are those of the difference where the sum is negative."""

    def show(z):
        none = z["places"] == ""
        shown = F.when(none, F.lit("0")).otherwise(z["places"])
        negative = F.startswith(z["total"], F.lit("-"))
        # a negative sum is -(|total| - 0.places)
        nines = F.translate(F.left(z["places"], F.length(z["places"]) - 1), "0123456789", "9876543210")
        rest = F.concat(nines, F.translate(F.right(z["places"], F.lit(1)), "123456789", "987654321"))
        below = F.concat(F.lit("-"), (F.substring(z["total"], 2, 40).try_cast("decimal(38,0)") - 1).cast("string"), F.lit("."), rest)
        return F.when(negative & ~none, below).otherwise(F.concat(z["total"], F.lit("."), shown))

    places = F.rtrim(F.substring_index(digits, ".", -1), F.lit("0"))
    return let({"total": _added(F.substring_index(digits, ".", 1), change), "places": places}, show)


# up to 15 digits, so that sums are exact as longs
SMALL_WHOLE = r"^[1-9](?:[0-9]{0,14}|[0-9]{0,2}(?:,[0-9]{3}){1,4})\.?\z"


def perturb_value(number: Column, change: Column, handle_padding: bool = True) -> Column:
    """The text of ``number`` + ``change`` in the form of the old text; null where it has no such form. Both are used
    several times, so a column that costs much is best one of the table.

    Commas and the count of digits after the point are kept; with padding, leading zeros and a final period too.
    Null: an integer of zeros only, or digits that are not ASCII. Numbers too long for a decimal are added as digits.
    """

    def whole(z):
        total = F.try_add(z["digits"].try_cast("decimal(38,0)"), z["change"].cast("decimal(38,0)"))
        commas = F.contains(z["number"], F.lit(","))
        grouped = F.when(commas, F.format_number(total, 0))
        wide = _added(z["digits"], z["change"])
        wide = F.when(commas, F.reverse(F.regexp_replace(F.reverse(wide), r"([0-9]{3})(?=[0-9])", "$1,"))).otherwise(wide)
        return F.when(~z["digits"].rlike("^0+$"), F.coalesce(grouped, total.cast("string"), wide))

    def decimal(z):
        places = F.length(F.substring_index(z["digits"], ".", -1))
        scale = F.rpad(F.lit("1"), places + 1, F.lit("0")).try_cast("decimal(38,0)")
        scaled = F.replace(z["digits"], F.lit("."), F.lit("")).try_cast("decimal(38,0)")
        total = F.try_add(scaled, F.try_multiply(scale, z["change"].cast("decimal(20,0)")).try_cast("decimal(38,0)"))

        def show(y):
            size = F.length(y["size"])
            left = F.substring(y["size"], F.lit(1), size - y["places"])
            right = F.rtrim(F.substring(y["size"], size - y["places"] + 1, size), F.lit("0"))
            return F.concat(
                F.when(y["total"] < 0, F.lit("-")).otherwise(F.lit("")), left, F.lit("."),
                F.when(right == "", F.lit("0")).otherwise(right),
            )

        return let(
            {"total": total, "places": places},
            lambda y: let(
                {
                    "total": y["total"],
                    "places": y["places"],
                    "size": F.lpad(
                        F.abs(y["total"]).cast("string"),
                        F.greatest(F.length(F.abs(y["total"]).cast("string")), y["places"] + 1),
                        F.lit("0"),
                    ),
                },
                show,
            ),
        )

    def padded(y):
        if not handle_padding:
            return y["new"]
        dotted = F.when(F.endswith(y["number"], F.lit(".")), F.concat(y["new"], F.lit("."))).otherwise(y["new"])
        pads = F.startswith(y["digits"], F.lit("0")) & (F.length(y["digits"]) > 1)
        width = F.when(pads, F.length(y["number"])).otherwise(F.lit(0))
        return F.lpad(dotted, F.greatest(width, F.length(dotted)), F.lit("0"))

    def formed(z):
        readable = z["digits"].rlike(r"^[0-9]+(\.[0-9]+)?$")
        point = F.contains(z["digits"], F.lit("."))
        new = F.when(readable, F.when(point, F.coalesce(decimal(z), _added_decimal(z["digits"], z["change"]))).otherwise(whole(z)))
        return let({"number": z["number"], "digits": z["digits"], "new": new}, padded)

    def plain():
        """Short whole numbers without leading zeros, by native columns alone."""
        digits = F.replace(F.replace(number, F.lit(","), F.lit("")), F.lit("."), F.lit(""))
        total = digits.cast("long") + change.cast("long")
        new = F.when(F.contains(number, F.lit(",")), F.format_number(total, 0)).otherwise(total.cast("string"))
        return F.when(F.endswith(number, F.lit(".")), F.concat(new, F.lit("."))).otherwise(new) if handle_padding else new

    other = let(
        {"number": number, "change": change},
        lambda w: let(
            {
                "number": w["number"],
                "change": w["change"],
                "digits": F.btrim(F.replace(w["number"], F.lit(","), F.lit("")), F.lit(".")),
            },
            formed,
        ),
    )
    small = number.rlike(SMALL_WHOLE) & change.between(-(10**15), 10**15)
    return F.when(small, plain()).otherwise(other)


#: Why no text was made.
NO_NUMBER, NO_FORM = "no number at this position", "number has no changed form"


def number_intervention(
    key: Column,
    text: Column,
    position: str = "any",
    perturbation: str = "random",
    min_adjust: int = -3,
    max_adjust: int = 3,
    handle_padding: bool = True,
    remove_steps: bool = True,
    seed: str = SEED,
    noise=None,
    reasons: bool = False,
) -> Column:
    """Change one drawn number (``propcalc``: its first two places) and cut the text after the last change.

    Gives array<struct<part_no, perturbation, text>>, one entry per spec part with the same place for all. The array
    is empty when there is no candidate or the drawn number has no changed form; an empty text passes through.
    ``noise`` (``noise.matched_noise``) further changes the array of texts; it gives null when it cannot. With ``reasons`` the array is the field
    ``made`` of a struct, next to the ``reason`` why it is empty, null where it is not.
    """
    if position not in POSITIONS:
        raise ValueError(f"unknown position {position!r}")
    parts = number_parts(perturbation, min_adjust, max_adjust)

    def spliced(y):
        size = F.size(y["picks"])
        chosen = F.get(y["picks"], (draw(y["key"], "place", 0, seed) % F.greatest(size, F.lit(1))).cast("int"))
        fields = {
            "key": y["key"], "start": y["start"], "text": y["text"], "found": y["found"],
            "first": F.get(y["s"], chosen), "second": F.get(y["s"], chosen + 1),
        }
        return let(fields, lambda x: F.when(x["first"].isNotNull(), pieced(x)))

    def pieced(x):
        fields = {f: x[f] for f in ("key", "start", "text", "first", "second")}
        return let({**fields, "pieces": _pieces(x["found"])}, place)

    def upto(x, entry):
        return F.length(F.array_join(F.slice(x["pieces"], F.lit(1), entry["i"] + 1), ""))

    def place(x):
        fields = {
            "key": x["key"], "start": x["start"], "text": x["text"], "end": upto(x, x["first"]),
            "size": F.length(x["first"]["t"]),
        }
        if position == "propcalc":
            fields |= {"end2": upto(x, x["second"]), "size2": F.length(x["second"]["t"])}
        return let(fields, cut)

    def cut(x):
        fields = {
            "key": x["key"],
            "head": F.substring(x["text"], x["start"] + 1, x["end"] - x["size"] - x["start"]),
            "number": F.substring(x["text"], x["end"] - x["size"] + 1, x["size"]),
        }
        fields["changes"] = changes(x["key"])
        if position == "propcalc":
            fields["middle"] = F.substring(x["text"], x["end"] + 1, x["end2"] - x["size2"] - x["end"])
        return let(fields, lambda y: outputs(y, noise))

    def changes(key):
        return F.array(*[part_change(key, p, min_adjust, max_adjust, seed) for p in parts])

    def outputs(x, noise):
        new = [perturb_value(x["number"], x["changes"][i], handle_padding) for i in range(len(parts))]

        def joined(y):
            value = lambda i: y["new"][i]
            tail = lambda i: [x["middle"], value(i)] if position == "propcalc" else []
            texts = F.array(*[F.concat(x["head"], value(i), *tail(i)) for i in range(len(parts))])
            # where the noise can't be made, the texts are null: the number itself was found
            return F.coalesce(noise(x["key"], texts), F.array(F.lit(None).cast("string"))) if noise else texts

        return let({"new": F.array(*new)}, joined)

    def found_at(z):
        at = z["at"]
        part = lambda a, b: F.substring(z["text"], at[a] + 1, at[b] - at[a])
        fields = {"number": part("from1", "to1"), "head": at["head"] if noise else part("start", "from1"), "changes": changes(z["key"])}
        if position == "propcalc":
            fields["middle"] = at["middle"] if noise else part("to1", "from2")
        return F.when(at["to1"].isNotNull(), let(fields, lambda y: outputs(y, None)))

    no_form = NO_FORM if noise is None else f"{NO_FORM}, or too few letters"
    at = ascii.chosen_number(key, text, position, remove_steps, seed, noise)
    worked = F.when(at.isNotNull(), let({"key": key, "text": text, "at": at}, found_at)).otherwise(
        _split_numbers(key, text, position, remove_steps, spliced))
    names = F.array(*[F.lit(p.name) for p in parts])

    def named(t, i):
        return F.struct(
            i.cast("int").alias("part_no"), F.get(names, i).alias("perturbation"), strip(t).alias("text")
        )

    def checked(z):
        complete = z["texts"].isNotNull() & ~F.exists(z["texts"], lambda t: t.isNull())
        made = F.when(complete, F.transform(z["texts"], named)).otherwise(
            F.array().cast("array<struct<part_no:int,perturbation:string,text:string>>")
        )
        if not reasons:
            return made
        return F.struct(made.alias("made"), F.when(z["texts"].isNull(), NO_NUMBER).when(~complete, no_form).alias("reason"))

    blank = F.array(*[F.lit("") for _ in parts])
    return let({"texts": F.when(text == "", blank).otherwise(worked)}, checked)
