"""Hard negatives by a vertical scan: dimensions in the order of the anchor's magnitudes, with bounds on what remains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmark.operators.ordering import number_rows
from slipmark.sources.scratch import stored

#: Bytes of the anchors that are sent to the tasks at once; more anchors take further passes over the rows.
WAVE_BYTES = 32 << 20
#: Rows of a block in a task, and dimensions that are read between two looks at the bounds.
BLOCK_ROWS, STEP = 8192, 8
#: Doubles hold integers below this exactly.
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def matrix(lists: pa.Array, dims: int | None = None) -> np.ndarray:
    """One row of integers for each list; shorter lists end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    dims = max(int(sizes.max(initial=0)), dims or 0)
    if len(sizes) * dims == len(values):
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def _numbers(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``x`` as doubles where each sum of products with ``other`` is exact in doubles, else as whole numbers of any length."""
    size = x.shape[-1] * float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(other.astype(float)).max(initial=0))
    return x.astype(float if size < _EXACT else object)


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long are its ends."""
    return np.minimum(np.maximum(scores, -_LONG), _LONG) if scores.dtype == object else scores


class Block:
    """Rows as columns, grouped by label, with the least and the largest value of each column in each group."""

    def __init__(self, batch: pa.RecordBatch, anchors: np.ndarray):
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        order = np.argsort(labels, kind="stable")
        rows = matrix(batch.column("x"), anchors.shape[1])[order]
        self.columns = np.ascontiguousarray(_numbers(rows, anchors).T)
        self.labels = labels[order]
        self.ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[order]
        self.keys = batch.column("row").to_numpy(zero_copy_only=False)[order]
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.by_label: dict[int, tuple[slice, np.ndarray, np.ndarray]] = {}
        edges = np.flatnonzero(np.diff(self.labels)) + 1
        for a, b in zip([0, *edges], [*edges, len(labels)], strict=True):
            part = self.columns[:, a:b]
            self.by_label[int(self.labels[a])] = slice(a, b), part.min(axis=1), part.max(axis=1)


def vertical_scan(
    columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, bitmap: np.ndarray,
    keep: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the candidates that are left after all dimensions.

    The dimensions are read by falling magnitude of the anchor, ``STEP`` at a time. What the others can still add lies
    between the sums of their least and largest contributions; ``keep`` gets each candidate's bounds and gives its bit.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * low, anchor * high])[:, order]
    rest = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    least, most = rest(ends.min(axis=0)), rest(ends.max(axis=0))
    left = np.flatnonzero(bitmap)
    scores = np.zeros(len(left), columns.dtype)
    for at in range(0, len(order), STEP):
        dims = order[at : at + STEP]
        read = columns[dims] if len(left) == columns.shape[1] else columns[np.ix_(dims, left)]
        scores = scores + anchor[dims] @ read
        end = min(at + STEP, len(order))
        alive = keep(_as_long(scores + least[end]), _as_long(scores + most[end]))
        if not alive.all():
            left, scores = left[alive], scores[alive]
        if not len(left):
            break
    return left, _as_long(scores)


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then rising id."""
    if len(scores) > k:
        among = scores >= _kth(scores, k)
        scores, ids = scores[among], ids[among]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def positives_of(block: Block, label: int, key: int, anchor: np.ndarray, k: int, floor) -> tuple[np.ndarray, np.ndarray]:
    """The best rows of the label in the block, the row ``key`` left out; ``floor``: the k-th best score known (or None)."""
    if label not in block.by_label:
        return np.empty(0), np.empty(0, np.int64)
    at, low, high = block.by_label[label]

    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        bar = _kth(least, k) if len(least) >= k else None
        bar = floor if bar is None or (floor is not None and floor > bar) else bar
        return most >= bar if bar is not None else np.ones(len(most), bool)

    left, scores = vertical_scan(block.columns[:, at], low, high, anchor, block.keys[at] != key, keep)
    return best(scores, block.ids[at][left], k)


def negatives_of(
    block: Block, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], floors: list, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best rows of other labels in each window of scores; ``floors``: the k-th best score known in each (or None)."""

    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(least), bool)
        for (low, high), floor in zip(windows, floors, strict=True):
            sure = least[(least >= low) & (most <= high)]
            bar = max(low, low if floor is None else floor, _kth(sure, k) if len(sure) >= k else low)
            out |= (most >= bar) & (least <= high)
        return out

    left, scores = vertical_scan(block.columns, block.low, block.high, anchor, block.labels != label, keep)
    ids, out = block.ids[left], []
    for low, high in windows:
        inside = (scores >= low) & (scores <= high)
        out.append(best(scores[inside], ids[inside], k))
    return out


def _merge(known: tuple[np.ndarray, np.ndarray] | None, found: tuple[np.ndarray, np.ndarray], k: int):
    if known is None or not len(known[0]):
        return found
    return best(np.concatenate([known[0], found[0]]), np.concatenate([known[1], found[1]]), k) if len(found[0]) else known


def _blocks(batches: Iterator[pa.RecordBatch], anchors: np.ndarray) -> Iterator[Block]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield Block(batch.slice(at, BLOCK_ROWS), anchors)


def _rows(found: dict, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each key (a tuple of whole numbers), score and id."""
    rows = [(*key, int(s), int(i)) for key, (scores, ids) in found.items() for s, i in zip(scores, ids, strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def _first(df: DataFrame, by: list[str], score: str, ident: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(ident))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(
    rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for all rows where ``anchors`` holds.

    ``rows`` has ``vec_id, embedding, label``. Each component becomes ``floor(scale * x)``; a score is the whole inner
    product. An anchor's positives are its best rows of the same label; for each, the negatives are the best rows of other
    labels with ``low`` to ``high`` percent of the positive's score. Equal scores stand in the order of ``vec_id``.

    The rows are read in blocks of columns, label by label. A task keeps the best of each anchor over all its blocks, so
    later blocks begin with a bound. Anchors are handled in waves of at most ``WAVE_BYTES``: this bounds what is
    broadcast, and each wave is written, so a lost executor costs tasks of one wave. No group is gathered: the tasks' first
    few rows of each anchor are ranked again. All scores are exact: doubles where they suffice, else numbers of any length.

    Rows with a null id, label, vector or component, or with a component that is not finite, take no part. Shorter vectors
    end in zeros. Repeated rows are rows like others: an anchor's own copies are positives, and it has results of each of its
    rows. An empty table, or one without anchors, gives no rows. Other columns, whatever their names, are not read.
    Components and scores beyond a long are its ends.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    used = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")))
    table = stored(
        used.select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"), whole.alias("x"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        ),
        "vectors",
    )
    spark = rows.sparkSession
    numbered = stored(number_rows(table.where("is_anchor"), ["row"], "anchor"), "anchors")
    count, dims = numbered.agg(F.count("*"), F.max(F.size("x"))).first()
    per_wave = max(1, WAVE_BYTES // (8 * max(1, dims or 0)))
    read = table.select("row", "vec_id", "label", "x")
    out = None
    for start in range(0, max(1, count), per_wave):
        wave = numbered.where((F.col("anchor") >= start) & (F.col("anchor") < start + per_wave))
        made = stored(_wave(spark, read, wave, positives, negatives, low, high), "hard-negatives")
        out = made if out is None else out.unionAll(made)
    return out


def _wave(spark, read: DataFrame, wave: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The results of at most WAVE_BYTES of anchors, in two passes: positives, then the windows that they give."""
    held = wave.select("anchor", "row", "label", "x").orderBy("anchor").toArrow().combine_chunks()
    first = int(held["anchor"][0].as_py()) if held.num_rows else 0
    keys, labels = (held[c].to_numpy() for c in ("row", "label"))
    vectors = matrix(held["x"].combine_chunks()) if held.num_rows else np.zeros((0, 0), np.int64)
    sent = spark.sparkContext.broadcast((keys, labels, vectors))

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, vectors = sent.value
        found: dict[tuple[int], tuple[np.ndarray, np.ndarray]] = {}
        for block in _blocks(batches, vectors):
            for i in range(len(keys)):
                anchor = _anchor(vectors[i], block)
                known = found.get((first + i,))
                floor = known[0][-1] if known is not None and len(known[0]) == positives else None
                new = positives_of(block, int(labels[i]), keys[i], anchor, positives, floor)
                found[(first + i,)] = _merge(known, new, positives)
        yield from _rows(found, ["anchor", "positive_score", "positive_id"])

    schema = "anchor long, positive_score long, positive_id long"
    chosen = stored(
        _first(read.mapInArrow(find_positives, schema), ["anchor"], "positive_score", "positive_id", positives, "positive_rank"),
        "positives",
    )
    scores: dict[int, list[int]] = {}
    for r in chosen.select("anchor", "positive_score").distinct().collect():  # at most ``positives`` for each anchor of a wave
        scores.setdefault(r.anchor, []).append(r.positive_score)
    sent_scores = spark.sparkContext.broadcast(scores)

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, vectors = sent.value
        windows = {}
        for anchor, known in sent_scores.value.items():
            spans = [(p, (-(-low * p // 100), high * p // 100)) for p in known]
            windows[anchor] = [(p, w) for p, w in spans if w[0] <= w[1]]
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for block in _blocks(batches, vectors):
            for number, spans in windows.items():
                if not spans:
                    continue
                i = number - first
                known = [found.get((number, p)) for p, _ in spans]
                floors = [k[0][-1] if k is not None and len(k[0]) == negatives else None for k in known]
                new = negatives_of(block, int(labels[i]), _anchor(vectors[i], block), [w for _, w in spans], floors, negatives)
                for (p, _), before, one in zip(spans, known, new, strict=True):
                    found[(number, p)] = _merge(before, one, negatives)
        yield from _rows(found, ["anchor", "positive_score", "negative_score", "negative_id"])

    schema = "anchor long, positive_score long, negative_score long, negative_id long"
    hard = _first(
        read.mapInArrow(find_negatives, schema), ["anchor", "positive_score"], "negative_score", "negative_id", negatives, "rank"
    )
    ids = wave.select("anchor", F.col("vec_id").alias("anchor_id"))
    return chosen.join(hard, ["anchor", "positive_score"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _anchor(vector: np.ndarray, block: Block) -> np.ndarray:
    """The anchor in the block's kind of numbers and as long as its columns."""
    out = np.zeros(block.columns.shape[0], block.columns.dtype)
    out[: len(vector)] = vector
    return out
