"""Skips, limits, samples and batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmark.functions import fixed
from slipmark.functions.draws import SEED, digest
from slipmark.operators.ordering import number_rows
from slipmark.operators.selection import between_ranks
from slipmark.sources.scratch import stored


def skip_limit(df: DataFrame, order: list[str], skip: int = 0, limit: int = -1) -> DataFrame:
    """Skip ``skip`` rows in order and take ``limit`` (all for a negative limit); the keys at the cuts are selected, whatever the size."""
    skip = max(skip, 0)
    return between_ranks(df, order, skip, None if limit < 0 else skip + limit)


def skip_rows(df: DataFrame, order: list[str], skip: int) -> DataFrame:
    return skip_limit(df, order, skip, -1)


def limit_valid(df: DataFrame, valid: Column, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows that count; others neither count nor stay."""
    return skip_limit(df.where(valid), order, 0, limit)


def round_robin(df: DataFrame, order: list[str], batches: int) -> DataFrame:
    """Row i goes to batch i mod ``batches``."""
    return number_rows(df, order).withColumn("batch", F.col("row_no") % batches)


def draw_sample(df: DataFrame, key: str, size: int, seed: str = SEED) -> DataFrame:
    """A uniform sample of ``size`` rows by hash order of the key; the same rows whenever it is drawn again.

    Only the key and its hash are read to find the cut.
    """
    ranked = df.withColumn("_rank", digest(F.col(key), "sample", seed))
    return between_ranks(ranked, ["_rank", key], 0, size).drop("_rank")


def stored_sample(df: DataFrame, key: str, size: int, path: str, by: list[str]) -> DataFrame:
    """The sample of this size and these ``by`` values, from ``path`` when it is there, else drawn and kept there."""
    folder = f"{path}/n={size}"
    try:
        return df.sparkSession.read.parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    draw_sample(df, key, size).select(key, *by).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def batch_inputs(df: DataFrame, shard: str, order: list[str], cost: Column, model: str, threads: int = 1) -> DataFrame:
    """The batches of a request list: round robin for several threads, one item each for chat models, else by cost."""
    if threads > 1:
        return round_robin(df, order, threads)
    family = "gpt-4" if "gpt-4" in model else "chat" if _base_name(model) in fixed.CHAT_MODELS else "text"
    if family != "text":
        return number_rows(df, order, "batch")
    return token_budget_batches(df, shard, order, cost, fixed.RATE_LIMITS[family][1])


def _base_name(model: str) -> str:
    found = re.search(r"gpt-[^\s:]+", model)
    return found.group() if found else model.split("/")[-1].split("-")[0]


def token_budget_batches(
    df: DataFrame,
    shard: str,
    order: list[str],
    cost: Column,
    token_limit: int,
    chunk_rows: int = 100_000,
    own_cost: bool = False,
    fan: int = 64,
) -> DataFrame:
    """Greedy batches in order within each shard; gives shard, order and ``batch``, counted from 0 per shard.

    A batch is closed before an item when its cost so far plus the cost of the item before (``own_cost``: of the item
    itself) reaches the limit. This is sequential, but a shard of any size is still worked in parallel: it is cut
    into chunks of ``chunk_rows`` items, and a first pass maps, for each chunk, the cost of the batch that is open
    before it to the cost of the batch that is open after it. The map is a step function: the first close in a chunk
    lies within one batch length, so it has at most (items in a batch + 2) steps, and equal neighbours are merged.
    Two neighbours' maps compose to a map of the same kind, so the chunks are a tree: ``fan`` neighbours at a time
    become one map, round after round, until a shard has at most ``fan`` of them; then the states before each go down
    the same tree, and a last pass numbers all chunks at once. No group holds more than ``fan`` maps or one chunk.

    A null cost is 0. Null shards are one shard; an empty table gives no rows.
    """
    costs = F.greatest(F.coalesce(cost.cast("long"), F.lit(0)), F.lit(0))
    numbered = number_rows(df.select(shard, *order, costs.alias("_cost")), [shard, *order], "_no")
    # stored, as the shard starts, the first and the last pass all read it
    numbered = stored(numbered, "budget-items")
    starts = numbered.groupBy(shard).agg(F.min("_no").alias("_first"))  # one row per shard
    same = F.col(shard).eqNullSafe(F.col("_shard"))
    placed = numbered.join(starts.withColumnRenamed(shard, "_shard"), same).withColumn("_no", F.col("_no") - F.col("_first"))
    placed = placed.drop("_shard", "_first").withColumn("_chunk", F.floor(F.col("_no") / chunk_rows))
    types = dict(df.dtypes)
    key_type, state = f"`{shard}` {types[shard]}, _chunk long", "_tokens long, _before long, _batch long"
    map_schema = f"{key_type}, kind int, need long, tokens long, closed long, last_cost long"
    columns = ["kind", "need", "tokens", "closed", "last_cost"]

    def framed(rows: list[tuple], key: tuple, names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, "_chunk", int(key[1]))
        out.insert(0, shard, pd.Series([key[0]] * len(out), dtype=object))
        return out

    def outcomes(key, pdf):
        ordered = pdf.sort_values("_no")["_cost"].to_numpy(np.int64)
        return framed(_chunk_map(ordered, token_limit, own_cost), key, columns)

    def composed(key, pdf):
        maps = _maps(pdf)
        whole = maps[0][1]
        for _, rows in maps[1:]:
            whole = _compose(whole, rows, token_limit, own_cost)
        return framed(whole, key, columns)

    def followed(key, pdf):
        first = pdf.iloc[0]
        at, out = (int(first["_tokens"]), int(first["_before"]), int(first["_batch"])), []
        for chunk, rows in _maps(pdf):
            out.append((key[0], chunk, *at))
            at = _follow(rows, *at, token_limit, own_cost)
        return pd.DataFrame(out, columns=[shard, "_chunk", "_tokens", "_before", "_batch"])

    up = F.expr(f"_chunk div {fan}").alias("_up")
    levels = [stored(
        placed.select(shard, "_chunk", "_no", "_cost").groupBy(shard, "_chunk").applyInPandas(outcomes, map_schema), "budget-maps"
    )]
    most = levels[0].agg(F.max("_chunk")).first()[0] or 0
    while most >= fan:
        levels.append(stored(levels[-1].groupBy(shard, up).applyInPandas(composed, map_schema), "budget-maps"))
        most //= fan
    begin = {"_tokens": F.lit(_NONE_OPEN), "_before": F.lit(0), "_batch": F.lit(-1)}
    entries = levels[-1].withColumns(begin).groupBy(shard, up).applyInPandas(followed, f"{key_type}, {state}")
    for maps in reversed(levels[:-1]):
        above = stored(entries, "budget-states").withColumnsRenamed({shard: "_shard", "_chunk": "_parent"})
        inside = maps.join(above, F.col(shard).eqNullSafe(F.col("_shard")) & (F.expr(f"_chunk div {fan}") == F.col("_parent")))
        entries = inside.groupBy(shard, up).applyInPandas(followed, f"{key_type}, {state}")

    def assign(pdf):
        pdf = pdf.sort_values("_no")
        first = pdf.iloc[0]
        ordered = pdf["_cost"].to_numpy(np.int64)
        closes = _closes(ordered, int(first["_tokens"]), int(first["_before"]), token_limit, own_cost)
        pdf["batch"] = np.cumsum(closes) + int(first["_batch"])
        return pdf[[shard, *order, "batch"]]

    schema = ", ".join(f"`{c}` {types[c]}" for c in [shard, *order]) + ", batch long"
    entries = entries.withColumnsRenamed({shard: "_shard", "_chunk": "_entry"})
    known = placed.join(entries, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("_chunk") == F.col("_entry")))
    return known.drop("_shard", "_entry").groupBy(shard, "_chunk").applyInPandas(assign, schema)


#: The cost of the open batch where there is none yet.
_NONE_OPEN = -1


def _maps(pdf: pd.DataFrame) -> list[tuple[int, list[tuple]]]:
    """The maps of a group of chunks in order, each as rows by falling need."""
    out = []
    for chunk, rows in pdf.groupby("_chunk", sort=True):
        values = rows[["kind", "need", "tokens", "closed", "last_cost"]].to_numpy(np.int64).tolist()
        out.append((int(chunk), sorted(map(tuple, values), key=lambda r: (r[0], -r[1]))))
    return out


class _Walk:
    """Where the greedy batches of a chunk close, once it is known where one begins."""

    def __init__(self, costs: np.ndarray, limit: int, own_cost: bool):
        self.costs, self.limit = costs, limit
        self.before = np.concatenate([[0], np.cumsum(costs)])
        test = costs if own_cost else np.concatenate([[0], costs[:-1]])
        # an open batch of cost t from before the chunk closes before item j when t + reach[j] >= limit
        self.reach = self.before[:-1] + test
        self.highest = np.maximum.accumulate(self.reach)
        self.regular = costs.size == 0 or costs.max() < limit

    def next_close(self, i: int) -> int:
        """The item before which a batch beginning with item i closes; the chunk length if it stays open."""
        goal = self.limit + self.before[i]
        if self.regular:
            return int(np.searchsorted(self.highest, goal))
        hits = np.nonzero(self.reach[i + 1 :] >= goal)[0]
        return i + 1 + int(hits[0]) if hits.size else self.costs.size


def _chunk_map(costs: np.ndarray, limit: int, own_cost: bool) -> list[tuple]:
    """Rows (kind, need, tokens, closed, last_cost).

    kind 1: an open batch of cost at least ``need`` (and below that of the row before) leaves ``tokens`` open after
    ``closed`` closes. kind 2: none of these, the batch stays open and grows by ``tokens``. kind 0: a close before
    the first item, because the batch was full already.
    """
    walk = _Walk(costs, limit, own_cost)
    size, last = costs.size, int(costs[-1])
    known: dict[int, tuple[int, int]] = {}

    def finish(start):
        path, i = [], start
        while i < size and i not in known:
            path.append(i)
            i = walk.next_close(i)
        for step in reversed(path):
            after = walk.next_close(step)
            if after >= size:
                known[step] = (int(walk.before[size] - walk.before[step]), 1)
            else:
                known[step] = (known[after][0], known[after][1] + 1)
        return known[start]

    rows = [(0, 0, *finish(0), last)]
    lowest = None
    for j in range(0 if own_cost else 1, size):
        need = limit - int(walk.reach[j])
        if lowest is not None and need >= lowest:
            continue
        lowest = need
        tokens, closed = finish(j)
        if rows and rows[-1][0] == 1 and rows[-1][2:4] == (tokens, closed):
            rows[-1] = (1, need, tokens, closed, last)
        else:
            rows.append((1, need, tokens, closed, last))
        if need <= 0:
            break
    rows.append((2, 0, int(walk.before[size]), 0, last))
    return rows


def _follow(rows: list[tuple], tokens: int, cost_before: int, batch: int, limit: int, own_cost: bool) -> tuple[int, int, int]:
    """The open batch after a chunk (its cost, the last item's cost, its number) from the one before."""
    fresh, last = rows[0], rows[0][4]
    if tokens == _NONE_OPEN or (not own_cost and tokens + cost_before >= limit):
        return fresh[2], last, batch + fresh[3]
    for kind, need, left, closed, _ in rows[1:]:
        if kind == 2:
            return tokens + left, last, batch
        if need <= tokens:
            return left, last, batch + closed
    raise AssertionError("a map ends with its open row")


def _compose(first: list[tuple], then: list[tuple], limit: int, own_cost: bool) -> list[tuple]:
    """The map of two neighbours from their own.

    A batch that closes in the first chunk enters the second with a known cost. One that stays open is ``grown`` larger
    there, so the second chunk's steps are lower by that; those that the first chunk closes already are never met.
    """
    cost_before, last = first[0][4], then[0][4]

    def go_on(tokens: int, closed: int) -> tuple[int, int]:
        tokens, _, closed = _follow(then, tokens, cost_before, closed, limit, own_cost)
        return tokens, closed

    rows = [(0, 0, *go_on(*first[0][2:4]), last)]
    steps = [(need, *go_on(left, closed)) for kind, need, left, closed, _ in first if kind == 1]
    grown = first[-1][2]
    if not own_cost:
        steps.append((limit - cost_before - grown, *then[0][2:4]))
    steps += [(need - grown, left, closed) for kind, need, left, closed, _ in then if kind == 1]
    lowest = None
    for need, left, closed in steps:
        if lowest is not None and (need >= lowest or lowest <= 0):
            continue
        lowest = need
        if rows[-1][0] == 1 and rows[-1][2:4] == (left, closed):
            rows[-1] = (1, need, left, closed, last)
        else:
            rows.append((1, need, left, closed, last))
    return [*rows, (2, 0, grown + then[-1][2], 0, last)]


def _closes(costs: np.ndarray, tokens: int, cost_before: int, limit: int, own_cost: bool) -> np.ndarray:
    """1 at each item before which a batch closes."""
    walk = _Walk(costs, limit, own_cost)
    out = np.zeros(costs.size, np.int64)
    if tokens == _NONE_OPEN:
        i = 0
    elif not own_cost and tokens + cost_before >= limit:
        i = 0
    else:
        reach = walk.reach.copy()
        if not own_cost:
            reach[0] = -limit - tokens  # checked above
        hits = np.nonzero(reach + tokens >= limit)[0]
        i = int(hits[0]) if hits.size else costs.size
    while i < costs.size:
        out[i] = 1
        i = walk.next_close(i)
    return out
