"""Reproducible draws: the first 32 bits of an md5 over seed, key, purpose and number.

A draw depends on the row's key only, so results do not change with partitioning, retries or cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmark.functions.lets import let

SEED = "7"


def digest(key: Column, purpose: str, seed: str = SEED, *more: Column) -> Column:
    parts = [F.lit(seed), key, F.lit(purpose), *[m.cast("string") for m in more]]
    return F.md5(F.concat_ws("|", *parts))


def draw(key: Column, purpose: str, i: Column | int = 0, seed: str = SEED) -> Column:
    """A whole number in [0, 2**32)."""
    number = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(digest(key, purpose, seed, number), 1, 8), 16, 10).cast("long")


def sample_positions(key: Column, population: Column, size: int, purpose: str, seed: str = SEED) -> Column:
    """``size`` distinct positions of 0 .. population-1 in random order; population must not be below size.

    Draw i is a rank among the positions not yet taken. Going back over the earlier draws, a rank that is not below theirs
    is one higher in what was left before; at the first draw the rank is the position.
    """
    if size == 0:
        return F.array().cast("array<long>")
    ranks = lambda z: F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: draw(z["key"], purpose, i, seed) % F.greatest(z["n"] - i, F.lit(1).cast("long")),
    )
    back = lambda y, rank, i: F.aggregate(
        F.reverse(F.slice(y["ranks"], F.lit(1), i)), rank, lambda r, earlier: F.when(r >= earlier, r + 1).otherwise(r)
    )
    return let(
        {"key": key, "n": population.cast("long")},
        lambda z: let({"ranks": ranks(z)}, lambda y: F.transform(y["ranks"], lambda rank, i: back(y, rank, i))),
    )
