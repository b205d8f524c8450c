"""Rows by their place in an order, without sorting or storing the table: selection of the keys at the cuts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Keys drawn to narrow a range, and rows of a range that are ranked directly (keys only).
SAMPLE, DIRECT = 1 << 14, 1 << 17


def _key(order: list[str]) -> Column:
    """Compares like the order: nulls first, then column by column."""
    return F.struct(*order)


def _at(df: DataFrame, order: list[str], key: Row) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, key, strict=True)])


def _from(df: DataFrame, order: list[str], key: Row) -> Column:
    """Rows not before ``key``; the first column's bound also stands alone, so that a scan can use it."""
    here = _key(order) >= _at(df, order, key)
    return here if key[0] is None else here & (F.col(order[0]) >= F.lit(key[0]))


def _before(df: DataFrame, order: list[str], key: Row) -> Column:
    here = _key(order) < _at(df, order, key)
    if key[0] is None:
        return here
    return here & (F.col(order[0]).isNull() | (F.col(order[0]) <= F.lit(key[0])))


def _bracket(drawn: list[Row], place: float) -> tuple[Row | None, Row | None]:
    """Two drawn keys around a relative place, three deviations apart from it, so that the key at it almost surely lies between."""
    n = len(drawn)
    wide = 3 * math.sqrt(n * place * (1 - place)) + 3
    low, high = math.floor(n * place - wide), math.ceil(n * place + wide)
    return drawn[low] if low >= 0 else None, drawn[high] if high < n else None


def key_at(df: DataFrame, order: list[str], rank: int, count: int | None = None) -> tuple[Row, int] | None:
    """The key of the row at ``rank`` (from 0), and how many rows with an equal key stand before that row; None beyond the last.

    Keys are drawn at random from a range, two of them are put around the rank, and the rows before and between these
    are counted; then only the rows between them are looked at, until few are left. A bracket that misses is only a
    narrower range elsewhere. Each round cuts a range of n rows to about n / 40 (far fewer near its ends), and reads the key
    columns alone. Nothing is stored, and no task gets more than ``DIRECT`` keys, however many rows there are.
    """
    keys = df.select(*order)
    inside, size = keys, keys.count() if count is None else count
    if rank >= size:
        return None
    while size > DIRECT:
        draw = inside.where(F.rand(7) < SAMPLE / size)
        low, high = _bracket([tuple(r) for r in draw.orderBy(*order).collect()], rank / size)  # about SAMPLE keys
        zone = F.lit(1)
        if high is not None:
            zone = F.when(~_before(keys, order, high), 2).otherwise(zone)
        if low is not None:
            zone = F.when(_before(keys, order, low), 0).otherwise(zone)
        counts = {r.zone: r.n for r in inside.groupBy(zone.alias("zone")).agg(F.count("*").alias("n")).collect()}
        before, between = counts.get(0, 0), counts.get(1, 0)
        if rank < before:
            inside, left = inside.where(_before(keys, order, low)), before
        elif rank < before + between:
            if low is not None:
                inside = inside.where(_from(keys, order, low))
            if high is not None:
                inside = inside.where(_before(keys, order, high))
            rank, left = rank - before, between
        else:
            inside, rank, left = inside.where(_from(keys, order, high)), rank - before - between, size - before - between
        if left == size:  # the keys drawn are equal, or nearly so: take the most frequent one out
            return _among_equal(keys, inside, order, rank, size)
        size = left
    ranked = inside.withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1)  # at most DIRECT keys
    ranked = ranked.withColumn("_equal", F.row_number().over(Window.partitionBy(*order).orderBy("_place")) - 1)
    found = ranked.where(F.col("_place") == rank).first()
    return tuple(found[c] for c in order), found["_equal"]


def _among_equal(keys: DataFrame, inside: DataFrame, order: list[str], rank: int, size: int) -> tuple[Row, int]:
    """A key with very many rows: count those before and at it, and go on beside it where the rank is not there."""
    key = tuple(inside.groupBy(*order).agg(F.count("*").alias("_count")).orderBy(F.desc("_count"), *order).first())[:-1]
    zone = F.when(_before(keys, order, key), 0).when(_key(order) == _at(keys, order, key), 1).otherwise(2)
    counts = {r.zone: r.n for r in inside.groupBy(zone.alias("zone")).agg(F.count("*").alias("n")).collect()}
    before, equal = counts.get(0, 0), counts.get(1, 0)
    if before <= rank < before + equal:
        return key, rank - before
    if rank < before:
        return key_at(inside.where(_before(keys, order, key)), order, rank, before)
    rest = inside.where(_from(keys, order, key) & (_key(order) != _at(keys, order, key)))
    return key_at(rest, order, rank - before - equal, size - before - equal)


def between_ranks(df: DataFrame, order: list[str], start: int, end: int | None = None) -> DataFrame:
    """The rows from place ``start`` up to, not with, ``end`` in ``order``: a plain filter, whatever the size.

    Rows with equal keys have no defined place among each other. Where a cut falls among such rows, the right number
    of them is taken; only then are those rows limited, as all other rows are told by their keys.
    """
    if start <= 0 and end is None:
        return df
    if end is not None and end <= max(start, 0):
        return df.limit(0)
    count = df.select(*order).count()
    if start >= count:
        return df.limit(0)
    low = key_at(df, order, start, count) if start > 0 else None
    high = key_at(df, order, end, count) if end is not None else None
    same = low is not None and high is not None and low[0] == high[0]
    middle = df
    if low is not None:
        middle = middle.where(_from(df, order, low[0]))
    if high is not None:
        middle = middle.where(_before(df, order, high[0]))
    if same:
        return df.where(_key(order) == _at(df, order, low[0])).limit(high[1] - low[1])
    if low is not None and low[1]:
        equal = _key(order) == _at(df, order, low[0])
        among = df.where(equal)
        middle = middle.where(~equal).unionAll(among.limit(among.count() - low[1]))
    if high is not None and high[1]:
        middle = middle.unionAll(df.where(_key(order) == _at(df, order, high[0])).limit(high[1]))
    return middle
