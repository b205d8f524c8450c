"""Helpers for building one-row array expressions that evaluate each step once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(fields: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``fields`` once and use them in ``body``.

    The optimizer inlines a column that is used once, also when that use is inside a lambda, and would then run
    it per element. A lambda variable cannot be inlined, so each step here is bound as one.
    """
    row = F.struct(*[c.alias(n) for n, c in fields.items()])
    return F.element_at(F.transform(F.array(row), body), 1)


def indexes(n: Column) -> Column:
    """0 .. n-1 as an array, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


RUN = 256


def running_sums(values: Column) -> Column:
    """Running sums of an int array, in blocks: appending to one array all along would copy it once per entry."""
    none = F.array().cast("array<int>")

    def grow(items: Column, base: Column, size) -> Column:
        """Append running totals, from ``base``; the last entry holds the total so far."""
        add = lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), base) + size(v)))
        return F.aggregate(items, none, add)

    def blocks(z):
        part = lambda b: F.slice(z["v"], b * RUN + 1, F.lit(RUN))
        total = lambda b: F.aggregate(part(b), F.lit(0), lambda a, v: a + v)
        count = F.ceil(F.size(z["v"]) / RUN).cast("int")
        return let(
            {"v": z["v"], "blocks": indexes(count), "totals": grow(indexes(count), F.lit(0), total)},
            lambda y: F.flatten(
                F.transform(
                    y["blocks"],
                    lambda b: let(
                        {"items": F.slice(y["v"], b * RUN + 1, F.lit(RUN)), "base": F.coalesce(F.get(y["totals"], b - 1), F.lit(0))},
                        lambda x: grow(x["items"], x["base"], lambda v: v),
                    ),
                )
            ),
        )

    return let({"v": values}, blocks)


def strip(text: Column) -> Column:
    """Trim every Unicode blank on both sides."""
    from slipmark.functions.fixed import BLANKS

    return F.btrim(text, F.lit(BLANKS))


def string_of(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def array_rows(df, keep: list[str], array: Column):
    """One row per struct of ``array``, with its fields; rows without any give none.

    The outer form is used: for the inner one the optimizer adds a filter on the array below, which would compute it
    a second time.
    """
    made = df.select(*keep, F.posexplode_outer(array).alias("_place", "_entry"))
    return made.where(F.col("_place").isNotNull()).select(*keep, F.col("_place").alias("pos"), "_entry.*")
