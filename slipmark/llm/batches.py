"""Small helpers for Arrow batches inside tasks: text slices of bounded size, word hashes, id bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 1 << 19
_WORD_BASE = 0x9E3779B97F4A7C15
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
    dtype=np.uint64,
)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_WORD_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            base = _WORD_BASE
            back = pow(base, -1, 1 << 64)
            grow = lambda b: np.concatenate(
                [np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, b, dtype=np.uint64))]
            )
            self.up, self.down = grow(base), grow(back)
        return self.up, self.down


_powers = _Powers()


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have at most ``budget`` bytes, or are a single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the offset of each text (nulls are empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, which never cross texts, and the index of each text's first word."""
    first = np.zeros(len(inside) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(inside), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(inside), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without white space, A-Z lower-cased) of all texts, and where each text's begin."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, at = word_spans(~_SPACE[data], offsets)
    return span_hashes(data, starts, ends), at


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` hashed words."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total = total * _MULTIPLIERS[0] + mix(words[i : i + n] + _MULTIPLIERS[i % 5])
    return mix(total)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one."""
    words, at = hashed_words(column)
    found = windows(words, size)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= size:
            s = np.sort(found[a : b - size + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(mix(windows(words[a:b], int(n)) + np.uint64(n)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a sorted set."""
    up, _ = _powers.get(len(tokens))
    with np.errstate(over="ignore"):
        total = np.sum(tokens * up[: len(tokens)], dtype=np.uint64) + np.uint64(len(tokens))
        return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def list_array(parts: list[np.ndarray], dtype: pa.DataType) -> pa.Array:
    """A list column from one numpy array for each row (None: null)."""
    lengths = np.array([0 if p is None else len(p) for p in parts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    full = [p for p in parts if p is not None and len(p)]
    values = np.concatenate(full) if full else np.empty(0, dtype=np.int64)
    mask = pa.array([p is None for p in parts]) if any(p is None for p in parts) else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, dtype), mask=mask)


#: Bits of an id bitmap: one megabyte, whatever the input. Beyond so many ids it only lets more rows through.
BITMAP_BITS = 1 << 23


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size that holds every id of ``column``; rows it lets through may still be others."""
    bit = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    words = (
        ids.where(F.col(column).isNotNull())
        .select(bit.alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    )
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    for word, bits in words.collect():  # at most BITMAP_BITS / 64 rows
        out[word] = bits
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, ids: pa.Array) -> np.ndarray:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), BITMAP_BITS)
    return known & ((bitmap[values >> 6] >> (values & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
