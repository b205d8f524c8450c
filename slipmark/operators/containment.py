"""Drop questions that an earlier logged question contains.

``contains`` alone is a nested loop over all pairs. Here every step is an equi join, and a question is one row in each:

1. questions and logged texts are reduced to distinct texts in one aggregate, so any number of copies costs as much as one; a
   question equal to a logged text is contained;
2. every other question has a width W, the largest of ``_widths`` up to its length in bytes. Of the pieces of k = (W + 1) / 2 bytes in
   its first and its last W bytes the least one is its key. A text that holds the question holds the same W bytes, so this piece is
   also the least one of a window of W bytes of the text. The postings of a text are the least pieces of all its windows (about 2
   for each W - k + 1 bytes), each with fingerprints of the 8 bytes before and after it;
3. a question below 15 bytes is a piece as a whole.

Pieces are ordered by hash, but those that several texts of a bounded sample hold come last, so a question's key is a rare piece
where its text has one. This only orders pieces: no piece and no question is left out. Postings of a width with few questions are
kept only where a bitmap of these questions' keys allows it, before they are shuffled.

One text in which a question stands is enough, so the first candidate of each question is verified before the others are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmark.functions.text import normalize_question
from slipmark.sources.scratch import stored

#: Shorter questions are pieces as a whole.
SHORT = 15
#: Texts, and bytes of each, that say which pieces are common; bits of the bitmap of common pieces of one length.
SAMPLE, SAMPLE_BYTES, COMMON_BITS = 1 << 12, 1 << 12, 23
#: The keys of a width with up to so many questions are a bitmap in the tasks that make postings.
FEW = 1 << 16
#: Bytes of text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Bytes on each side of a piece that are part of a posting.
BESIDE = 8


def drop_contained(questions: DataFrame, log: DataFrame, question: str = "question", logged: str = "question") -> DataFrame:
    """The rows of ``questions`` whose question is in no logged question (carriage returns off, question trimmed).

    ``log`` holds the earlier rows of one model and style.
    """
    asked = questions.withColumn("_q", normalize_question(F.col(question)))
    done = contained_questions(asked.select("_q").where(F.col("_q").isNotNull()), log.select(F.col(logged).alias("_t")))
    return asked.join(done, "_q", "left_anti").drop("_q")


def contained_questions(asked: DataFrame, logged: DataFrame) -> DataFrame:
    """Distinct ``_q`` of ``asked`` that some ``_t`` of ``logged`` contains."""
    each = asked.select("_q", F.lit(True).alias("_asked"), F.lit(False).alias("_held")).unionAll(
        logged.select(F.replace("_t", F.lit("\r"), F.lit("")), F.lit(False), F.lit(True)).where("_t is not null"))
    one = each.groupBy("_q").agg(F.max("_asked").alias("_asked"), F.max("_held").alias("_held"))
    both = stored(one.withColumn("_tid", F.monotonically_increasing_id()).withColumn("_len", F.octet_length("_q")), "asked-and-logged")
    texts = both.where("_held").select(F.col("_q").alias("_t"), "_tid", "_len")
    found = both.where("_asked and _held").select("_q")
    longest = texts.agg(F.max("_len")).first()[0]
    if longest is None:
        return found  # no text
    rest = both.where("_asked and not _held").where(F.col("_len") <= longest)
    found = found.unionByName(rest.where("_len = 0").select("_q"))
    return found.unionByName(_by_pieces(rest.where("_len > 0"), texts, longest)).distinct()


def _widths(longest: int) -> list[int]:
    """1 to 14, then 15, 23, 31, 47, 63, …: a question's width is more than 60 % of its length."""
    out, w = list(range(1, SHORT)), SHORT
    while w <= longest:
        out += [w, w + (w + 1) // 2]
        w = 2 * w + 1
    return [w for w in out if w <= longest]


def _piece(width: int) -> int:
    return width if width < SHORT else (width + 1) // 2


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text begins and the last one ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, at = _bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(at, at[start] + SLICE_BYTES, side="right")) - 1, start + 1)
            yield batch.slice(start, end - start)
            start = end


class _Pieces:
    """Hashes of the pieces of a slice of texts, and their values in the order of keys: common ones after rare ones."""

    def __init__(self, data: np.ndarray, common: dict[int, np.ndarray]):
        n = len(data)
        up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)])
        self.common = common

    def hashes(self, size: int) -> np.ndarray:
        n = max(len(self.sums) - size, 0)
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))

    def values(self, size: int) -> np.ndarray:
        """At least 1; the highest bit is set for common pieces."""
        hashes = self.hashes(size)
        out = (hashes >> np.uint64(1)) | np.uint64(1)
        if size in self.common:
            at = (hashes >> np.uint64(64 - COMMON_BITS)).astype(np.int64)
            held = (self.common[size][at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1)
            out |= held.astype(np.uint64) << np.uint64(63)
        return out


def _over(values: np.ndarray, size: int, pick) -> np.ndarray:
    """The least or greatest of each ``size`` neighbours, by doubling."""
    n = 1
    while 2 * n <= size:
        values = pick(values[: len(values) - n], values[n:])
        n *= 2
    return pick(values[: len(values) - (size - n)], values[size - n :]) if n < size else values


def _beside(near: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """15 bits of the bytes from ``at`` on, -1 where they are not all between ``start`` and ``end``."""
    inside = (at >= start) & (at + BESIDE <= end)
    out = np.full(len(at), -1, dtype=np.int16)
    out[inside] = (near[at[inside]] & np.uint64(0x7FFF)).astype(np.int16)
    return out


def _key(values: np.ndarray, width: int) -> np.ndarray:
    return _mix(values ^ np.uint64(width * _BASE % (1 << 64)))


def _question_keys(rest: DataFrame, common: dict[int, np.ndarray]) -> DataFrame:
    """``_g, _l, _r, _q, _w``: each question with its key and the fingerprints beside the piece, -1 where the question ends there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("_w").to_numpy()
            for width in np.unique(widths).tolist():
                for part in _slices(iter([batch.filter(pa.array(widths == width))]), "_q"):
                    yield keyed(part, width)

    def keyed(part: pa.RecordBatch, width: int) -> pa.RecordBatch:
        data, at = _bytes(part.column("_q"))
        pieces, size = _Pieces(data, common), _piece(width)
        values = pieces.values(size)
        start, end = at[:-1], at[1:]
        best = where = None
        for first in (start, end - width):
            places = np.empty(len(start), dtype=np.int64)
            step = max(1, SLICE_BYTES // width)
            for a in range(0, len(start), step):
                here = first[a : a + step, None] + np.arange(width - size + 1)
                places[a : a + step] = first[a : a + step] + values[here].argmin(axis=1)
            least = values[places]
            where = places if best is None else np.where(least < best, places, where)
            best = least if best is None else np.minimum(best, least)
        near = pieces.hashes(BESIDE)
        beside = [_beside(near, x, start, end) for x in (where - BESIDE, where + size)]
        return pa.RecordBatch.from_arrays(
            [pa.array(_key(best, width).view(np.int64)), *[pa.array(b) for b in beside], part.column("_q"), part.column("_w")],
            ["_g", "_l", "_r", "_q", "_w"])

    return rest.mapInArrow(run, "_g long, _l short, _r short, _q string, _w int")


def _postings(texts: DataFrame, widths: list[int], common: dict[int, np.ndarray], few: dict[int, np.ndarray]) -> DataFrame:
    """``_g, _tl, _tr, _tid``: the least pieces of all windows of each width, where ``few`` has no bitmap against it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "_t"):
            data, at = _bytes(batch.column("_t"))
            pieces, near, rows = _Pieces(data, common), None, np.repeat(np.arange(batch.num_rows), np.diff(at))
            ids, ends = batch.column("_tid").to_numpy(), at[1:][rows]
            for width in widths:
                size, n = _piece(width), len(data) - width + 1
                if n < 1:
                    continue
                values, w = pieces.values(size), width - size + 1
                least = np.where(np.arange(n) + width <= ends[:n], _over(values, w, np.minimum), np.uint64(0))  # no window crosses texts
                none = np.zeros(w - 1, dtype=np.uint64)
                places = np.flatnonzero(_over(np.concatenate([none, least, none]), w, np.maximum) == values)
                keys = _key(values[places], width)
                if width in few:
                    held = _in(few[width], keys)
                    places, keys = places[held], keys[held]
                if not len(places):
                    continue
                near = pieces.hashes(BESIDE) if near is None else near
                row = rows[places]
                beside = [_beside(near, x, at[row], at[row + 1]) for x in (places - BESIDE, places + size)]
                if width < SHORT:
                    beside = [np.full(len(places), -1, dtype=np.int16)] * 2
                told = keys ^ (beside[0].astype(np.uint64) << np.uint64(48)) ^ (beside[1].astype(np.uint64) << np.uint64(32) >> np.uint64(16))
                _, one = np.unique(_mix(told) + _mix(row.astype(np.uint64)), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[one]) for x in (keys.view(np.int64), *beside, ids[row])], ["_g", "_tl", "_tr", "_tid"])

    return texts.select("_t", "_tid").mapInArrow(run, "_g long, _tl short, _tr short, _tid long")


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1)).astype(bool)


def _bitmap(at: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=np.uint8)
    out[at] = 1
    return np.packbits(out, bitorder="little")


def _common_pieces(texts: DataFrame, sizes: set[int]) -> dict[int, np.ndarray]:
    """For each length a bitmap of the pieces that several of at most ``SAMPLE`` texts hold. It only orders pieces."""
    some = texts.select(F.substring(F.col("_t").cast("binary"), 1, SAMPLE_BYTES).alias("_t")).orderBy(F.xxhash64("_tid"), "_t").limit(SAMPLE)
    held: dict[int, list[np.ndarray]] = {size: [] for size in sizes}
    for row in some.collect():  # at most 16 MB
        pieces = _Pieces(np.frombuffer(bytes(row[0]), dtype=np.uint8), {})
        for size in sizes:
            held[size].append(np.unique(pieces.hashes(size) >> np.uint64(64 - COMMON_BITS)))
    out = {}
    for size, parts in held.items():
        at, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0))
        if (counts > 1).any():
            out[size] = _bitmap(at[counts > 1].astype(np.int64), 1 << COMMON_BITS)
    return out


def _by_pieces(rest: DataFrame, texts: DataFrame, longest: int) -> DataFrame:
    width = F.lit(0)
    for w in _widths(longest):
        width = F.when(F.col("_len") >= w, w).otherwise(width) if w == 1 else F.greatest(width, F.when(F.col("_len") >= w, w).otherwise(0))
    rest = rest.select("_q", width.cast("int").alias("_w"))
    counts = {r[0]: r[1] for r in rest.groupBy("_w").count().collect()}  # one row per width: at most 14 and 2 for each doubling
    if not counts:
        return rest.select("_q")
    common = _common_pieces(texts, {_piece(w) for w in counts if w >= SHORT})
    keyed = stored(_question_keys(rest, common), "question-keys")
    few = {}
    for w in [w for w, n in counts.items() if n <= FEW]:
        few[w] = np.empty(0, np.int64)
    if few:
        got = keyed.where(F.col("_w").isin(sorted(few))).select("_w", "_g").distinct().toArrow()  # at most FEW keys of a width
        owner, keys = got["_w"].to_numpy(), got["_g"].to_numpy()
        for w in few:
            bits = 1 << max(10, (16 * counts[w]).bit_length())
            few[w] = _bitmap(keys[owner == w] & (bits - 1), bits)
    runs = _postings(texts, sorted(counts), common, few)
    same = ((F.col("_l") < 0) | (F.col("_l") == F.col("_tl"))) & ((F.col("_r") < 0) | (F.col("_r") == F.col("_tr")))
    pairs = stored(keyed.join(runs, "_g").where(same).select("_q", "_tid"), "containment-pairs")

    def checked(some: DataFrame) -> DataFrame:
        return some.join(texts.select("_t", "_tid"), "_tid").where(F.contains("_t", F.col("_q"))).select("_q").distinct()

    found = stored(checked(pairs.groupBy("_q").agg(F.min("_tid").alias("_tid"))), "contained-at-once")
    return found.unionByName(checked(pairs.join(found, "_q", "left_anti")))
