"""Perturbation specs: ``_``-joined parts such as ``random``, ``add1_add101`` or ``typo5_typo10``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NumberPart:
    name: str
    random: bool
    amount: int


@dataclass(frozen=True)
class LetterPart:
    name: str
    count: int


def number_parts(spec: str, min_adjust: int = -3, max_adjust: int = 3) -> list[NumberPart]:
    """Parse a number spec; a part that can never change a value is an error."""
    parts = []
    for name in spec.split("_"):
        found = re.search(r"add([1-9][0-9]*|0)(?![0-9])", name)
        if "add" in name and not found:
            raise ValueError(f"no amount after 'add' in {name!r}")
        amount = int(found.group(1)) if found else 0
        part = NumberPart(name, "random" in name, amount)
        if part.random:
            changes = [d for d in range(min_adjust, max_adjust + 1) if d + amount != 0]
        else:
            changes = [amount] if amount else []
        if not changes:
            raise ValueError(f"perturbation {name!r} never changes a value")
        parts.append(part)
    return parts


def letter_parts(spec: str) -> list[LetterPart]:
    parts = []
    for name in spec.split("_"):
        found = re.search(r"[0-9]+$", name)
        if "typo" not in name or not found:
            raise ValueError(f"letter perturbation {name!r} is not of the form typoN")
        parts.append(LetterPart(name, int(found.group())))
    return parts


def spec_parts(spec: Column) -> Column:
    """The parts of a spec column as array<struct<part_no, part, random, add_amount, trailing_number>>."""
    number = lambda text: F.expr("null").cast("long") if text is None else text

    def describe(part, i):
        added = F.regexp_extract(part, "add([0-9]+)", 1)
        trailing = F.regexp_extract(part, "([0-9]+)$", 1)
        return F.struct(
            i.cast("int").alias("part_no"),
            part.alias("part"),
            F.contains(part, F.lit("random")).alias("random"),
            F.when(added != "", number(added).cast("long")).alias("add_amount"),
            F.when(trailing != "", number(trailing).cast("long")).alias("trailing_number"),
        )

    return F.transform(F.split(spec, "_"), describe)
