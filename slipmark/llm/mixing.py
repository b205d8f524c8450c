"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipmark.sources.scratch import stored

#: Divisors tried in one pass over the parties.
_TRIES = 32
_ROUNDS = 9


def apportion(parties: DataFrame, seats: DataFrame) -> DataFrame:
    """Sainte-Laguë seats: ``grp, party, quota`` from ``parties(grp, party, votes)`` and ``seats(grp, seats)``.

    Giving each next seat to the highest quotient votes / (2 k + 1) is the same as quota = round(votes * x) for the x
    at which the quotas add up. Each pass tries many x for all groups at once and keeps the two around the goal. Where
    equal quotients leave no such x, the smaller party names are served first. A group without votes gets nothing.
    """
    quota = lambda x: F.floor(F.col("votes") * x + 0.5).cast("long")
    parties = stored(parties.where("votes > 0"), "mix-parties")
    totals = parties.groupBy("grp").agg(F.sum("votes").alias("v"), F.count("*").alias("p"))
    bounds = stored(
        totals.join(seats, "grp").select(
            "grp", "seats", F.greatest(F.lit(0.0), (F.col("seats") - F.col("p")) / F.col("v")).alias("lo"),
            ((F.col("seats") + F.col("p")) / F.col("v")).alias("hi"), F.lit(False).alias("exact")),
        "mix-bounds",
    )
    step = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * (i / _TRIES)
    for _ in range(_ROUNDS):
        if bounds.where("not exact").isEmpty():
            break
        tried = (
            parties.join(bounds, "grp").groupBy("grp", "seats", "lo", "hi", "exact")
            .agg(*[F.sum(quota(step(i))).alias(f"s{i}") for i in range(_TRIES + 1)])
            .select("*", F.array(*[F.struct(step(i).alias("x"), F.col(f"s{i}").alias("s")) for i in range(_TRIES + 1)]).alias("t"))
        )
        under = F.array_max(F.transform(F.filter("t", lambda e: e["s"] <= F.col("seats")), lambda e: e["x"]))
        over = F.array_min(F.transform(F.filter("t", lambda e: e["s"] >= F.col("seats")), lambda e: e["x"]))
        hit = F.array_min(F.transform(F.filter("t", lambda e: e["s"] == F.col("seats")), lambda e: e["x"]))
        bounds = stored(
            tried.select(
                "grp", "seats", F.coalesce(hit, under, "lo").alias("lo"), F.coalesce(hit, over, "hi").alias("hi"),
                (F.col("exact") | hit.isNotNull()).alias("exact")),
            "mix-bounds",
        )
    both = parties.join(bounds, "grp").select("grp", "party", "seats", quota(F.col("lo")).alias("q"), quota(F.col("hi")).alias("most"))
    given = both.groupBy("grp").agg(F.sum("q").alias("given"))
    # parties whose next quotient is the tied one; those served are numbered by name
    tied = both.where("most > q").withColumn("turn", F.row_number().over(Window.partitionBy("grp").orderBy("party")))
    more = (
        tied.join(given, "grp").where(F.col("turn") <= F.col("seats") - F.col("given")).select("grp", "party", F.lit(1).alias("more"))
    )
    return both.join(more, ["grp", "party"], "left").select("grp", "party", (F.col("q") + F.coalesce("more", F.lit(0))).alias("quota"))


def _targets(sizes: DataFrame, cycle: int, most: int) -> DataFrame:
    """Targets by weight, at most ``most`` times a source's size; the excess goes to the others by weight."""
    weighted = sizes.withColumn(
        # one row for each source
        "weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1
    )
    weighted = stored(weighted, "mix-sources")
    total, weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weights if weights else 0.0
    cap = most * F.col("source_size")
    while True:
        below = cap < F.col("weight") * F.lit(level)
        used, left = weighted.agg(F.sum(F.when(below, cap)), F.sum(F.when(~below, F.col("weight")))).first()
        after = ((total or 0) - (used or 0)) / left if left else level
        if after <= level:
            break
        level = after
    return weighted.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, most: int = 3,
    block_words: int = 16, shard_words: int = 1 << 18, seed: int = 17,
) -> DataFrame:
    """One row for each input row: ``doc_id, source, size, source_size, target, taken``.

    Sources by code point, null last, weigh 1 .. ``cycle``, repeating. Their targets are cut in blocks of
    ``block_words`` words, which Sainte-Laguë gives to the sources. A source is split by a seeded hash of the id into shards
    of about ``shard_words`` words, and its blocks are given to these in the same way; a shard takes its blocks in a seeded
    order of its documents, from the start again when it has used them all. ``taken`` is the number of words taken of
    a row, repeats counted, at most ``most`` times its size. A null text has size 0; a row of size 0 gives none;
    equal rows are told apart by nothing, so which of them gives the last block is open, while their number is not.
    """
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = stored(
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words.alias("size")),
        "mix-rows",
    )
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    rows = rows.withColumn("skey", key)
    sizes = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    targets = stored(_targets(sizes, cycle, most), "mix-targets")

    cut = F.ceil(F.col("source_size") / shard_words).cast("long")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    blocks = -(-total // block_words)
    one = F.lit("all").alias("grp")
    by_source = stored(
        apportion(
            targets.select(one, F.col("skey").alias("party"), F.col("target").alias("votes")),
            targets.select(one).distinct().withColumn("seats", F.lit(blocks).cast("long")),
        ), "mix-source-quotas",
    )
    placed = rows.join(targets.select("skey", "source_size", "target", cut.alias("cut")), "skey").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.lit(1).cast("long"), "cut"))
    )
    shards = stored(placed.where("size > 0").groupBy("skey", "shard").agg(F.sum("size").alias("shard_size")), "mix-shards")
    by_shard = apportion(
        shards.select(F.col("skey").alias("grp"), F.col("shard").alias("party"), F.col("shard_size").cast("double").alias("votes")),
        by_source.select(F.col("party").alias("grp"), F.col("quota").alias("seats")),
    )
    quotas = stored(
        shards.join(by_shard.select(F.col("grp").alias("skey"), F.col("party").alias("shard"), "quota"), ["skey", "shard"])
        .select("skey", "shard", "shard_size", F.least(F.col("quota") * block_words, F.col("shard_size") * most).alias("give")),
        "mix-shard-quotas",
    )
    order = Window.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "source")
    chosen = (
        placed.where("size > 0").join(quotas, ["skey", "shard"], "left")
        .withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("rest", F.col("give") % F.col("shard_size") - (F.col("end") - F.col("size")))
        .withColumn("taken", F.expr("(give div shard_size) * size") + F.greatest(F.lit(0), F.least("size", "rest")))
    )
    out = lambda df, taken: df.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
    return out(chosen, F.coalesce("taken", F.lit(0))).unionByName(out(placed.where("size = 0"), F.lit(0)))
