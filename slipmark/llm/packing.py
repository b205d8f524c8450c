"""Bounded-space online packing of tokenised documents into windows of one length."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmark.llm.batches import slices, text_bytes
from slipmark.sources.scratch import stored

#: Text handled at once in a task, bytes that a worker's lexicon may hold before it begins anew, and those of an entry by itself.
SLICE_BYTES, LEXICON_BYTES, UNIT_BYTES = 1 << 20, 160 << 20, 180
#: New units that the tokenizer gets as one text.
BATCH_UNITS = 1024

_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HAS_DIGIT = re.compile(rb"[0-9]")


def unit_cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where the bytes of a text can be cut so that its units, encoded alone, give the ids of the whole.

    A piece of the tokenizer is a contraction (an apostrophe and letters), a run of letters, one digit or a run of other
    marks, and never holds white space. So a text can be cut between two kinds of ASCII characters, but not behind an
    apostrophe, and not before a character beyond ASCII, which may combine with the one before it; the letters of Latin-1
    count as letters. ``ends`` and both ends of the bytes are cuts in any case.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    before, after = kind[:-1], kind[1:]
    cut = (before != after) | (before == _DIGIT)
    cut &= (after != _OTHER) | (before == _SPACE)
    cut &= (before != _OTHER) | (after == _SPACE)
    cut &= (data[:-1] != 0x27) | (after == _SPACE)
    flags = np.zeros(len(data) + 1, dtype=bool)
    flags[1:-1] = cut
    flags[ends] = flags[0] = flags[-1] = True
    return np.flatnonzero(flags)


class Lexicon:
    """Ids of units, filled by the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.zero,) = self.encode(["0"])[0]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.at, self.size = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.ids, self.used, self.kept = np.empty(1 << 14, np.uint32), 0, 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts by the library."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _batch(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units, one after the other, and how many each has.

        Units without an ASCII digit are encoded as one text with a ``0`` between them, which is a token of its own.
        """
        if any(_HAS_DIGIT.search(u) for u in units):
            found = self.encode([u.decode() for u in units])
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        ids = np.array(self.encode([(b" 0 ".join(units) + b" 0").decode()])[0], np.uint32)
        ends = np.flatnonzero(ids == self.zero)
        return ids[ids != self.zero], np.diff(ends, prepend=-1) - 1

    def _add(self, units: list[bytes]) -> None:
        digits = [u for u in units if _HAS_DIGIT.search(u)]
        plain = [u for u in units if not _HAS_DIGIT.search(u)] if digits else units
        for some in (digits, *(plain[i : i + BATCH_UNITS] for i in range(0, len(plain), BATCH_UNITS))):
            if not some:
                continue
            ids, size = self._batch(some)
            n, used = len(self.place), self.used
            if n + len(some) > len(self.at):
                self.at, self.size = np.resize(self.at, 2 * (n + len(some))), np.resize(self.size, 2 * (n + len(some)))
            if used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (used + len(ids)))
            self.ids[used : used + len(ids)] = ids
            self.size[n : n + len(some)] = size
            self.at[n : n + len(some)] = used + np.cumsum(size) - size
            self.place.update(zip(some, range(n, n + len(some)), strict=True))
            self.used += len(ids)
            self.kept += sum(map(len, some)) + 4 * len(ids) + UNIT_BYTES * len(some)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after the other, and where each text's begin."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        data = _LOWER[data]
        cuts = unit_cuts(data, offsets)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        found = coded.dictionary.to_pylist()
        known = self.place.get
        places = np.array([known(u, -1) for u in found], np.int64)
        new = np.flatnonzero(places < 0)
        self._add([found[i] for i in new])
        places[new] = [known(found[i]) for i in new]
        at, size = self.at[places], self.size[places]
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = size[code]
        before = np.concatenate([[0], np.cumsum(size)])
        taken = np.arange(before[-1]) + np.repeat(at[code] - before[:-1], size)
        ids = self.ids[taken]
        if self.kept > LEXICON_BYTES:
            self._clear()
        return ids, before[np.searchsorted(cuts, offsets)]


_lexicons: dict[str, Lexicon] = {}


def lexicon(path: str) -> Lexicon:
    """The worker's lexicon of a tokenizer; it outlives a task."""
    if path not in _lexicons:
        _lexicons[path] = Lexicon(path)
    return _lexicons[path]


def document_ids(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each row's id and token ids with ``end_id`` behind. A text with a special string is left to the library whole."""
    lex = lexicon(path)
    for batch in slices(batches, "text", SLICE_BYTES):
        rows, column = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_string()).fill_null("")
        ids, at = lex.encode_slice(*text_bytes(column))
        special = np.zeros(len(rows), dtype=bool)
        for mark in lex.special:
            special |= pa.compute.match_substring(column, mark).to_numpy(zero_copy_only=False)
        for i, row in enumerate(rows):
            own = np.array(lex.encode([column[i].as_py()])[0], np.uint32) if special[i] else ids[at[i] : at[i + 1]]
            yield row, np.append(own, np.uint32(end_id))


#: A piece: document, ids before it in the document, ids (little-endian unsigned 32-bit), all ids of the document.
Piece = tuple[int | None, int, bytes, int]
NAMES = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "part", "open"]
SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, part long, open boolean"
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def split_pieces(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``n`` ids, and the rest."""
    head: list[Piece] = []
    for i, (doc, start, ids, total) in enumerate(pieces):
        size = len(ids) // 4
        if size > n:
            if n:
                head.append((doc, start, ids[: 4 * n], total))
            return head, [(doc, start + n, ids[4 * n :], total), *pieces[i + 1 :]]
        head.append(pieces[i])
        n -= size
    return head, []


class Packer:
    """At most ``space`` open windows; each item goes to the one that it fills best.

    Where it fits into none, the fullest is closed. If that still lacks more than ``slack`` ids, it is first filled up
    with the head of the item, so no closed window ever has more padding than that.
    """

    def __init__(self, window: int, space: int, slack: int):
        self.window, self.space, self.slack = window, space, slack
        self.open: dict[int, list[Piece]] = {}
        self.free: dict[int, int] = {}

    def put(self, name: int, pieces: list[Piece], size: int) -> Iterator[tuple[int, list[Piece]]]:
        """Place an item of less than a window; ``name`` is the window's if it opens one. Gives the windows that close."""
        fits = [(f, w) for w, f in self.free.items() if f >= size]
        if not fits and len(self.open) >= self.space:
            gap, full = min((f, w) for w, f in self.free.items())
            if gap > self.slack:
                head, pieces = split_pieces(pieces, gap)
                self.open[full] += head
                size -= gap
            yield full, self.open.pop(full)
            del self.free[full]
            yield from self.put(name, pieces, size)
            return
        if fits:
            left, at = min(fits)
        else:
            left, at = self.window, name
            self.open[at] = []
        self.open[at] += pieces
        self.free[at] = left - size
        if left == size:
            del self.free[at]
            yield at, self.open.pop(at)


def _rows(name: int, pieces: list[Piece], part: int, still_open: bool) -> list[tuple]:
    out, at = [], 0
    for doc, start, ids, total in pieces:
        out.append((doc, start, ids, total, name, at, part, still_open))
        at += len(ids) // 4
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], NAMES)


def _windows(pdf: pd.DataFrame) -> list[tuple[int, list[Piece], int]]:
    """The windows of a group with their pieces and sizes, the fullest first."""
    held: dict[int, list[Piece]] = {}
    for r in pdf.sort_values(["sequence_id", "offset"]).itertuples(index=False):
        doc = None if pd.isna(r.doc_id) else int(r.doc_id)
        held.setdefault(int(r.sequence_id), []).append((doc, int(r.start), bytes(r.ids), int(r.doc_tokens)))
    sized = [(w, pieces, sum(len(p[2]) for p in pieces) // 4) for w, pieces in held.items()]
    return sorted(sized, key=lambda x: (-x[2], x[0]))


def last_windows(pieces: list[Piece], window: int, name: int) -> Iterator[tuple[int, list[Piece]]]:
    """Whole windows of what is left at the very end, and then lengths that are powers of two, which need no padding."""
    left = sum(len(p[2]) for p in pieces) // 4
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        head, pieces = split_pieces(pieces, size)
        yield name, head
        name, left = name + 1, left - size


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, space: int = 32, slack: int = 8, fan: int = 32
) -> DataFrame:
    """One row for each piece: ``doc_id, start, ids, doc_tokens, sequence_id, offset``.

    ``docs`` has ``doc_id`` and ``text``; other columns, whatever their names, are not read. A document's ids are the
    tokenizer's for the whole text and then ``end_id``. ``ids`` are little-endian unsigned 32-bit numbers. Each id is
    in exactly one piece; the pieces of a sequence follow each other from offset 0.

    Each scan partition packs its documents as they come, with ``space`` open windows. Whole windows of a long document
    are sequences by themselves. The windows that are open at the end are items of the next round: ``fan`` partitions'
    open windows are packed together in the same way, round after round, until one group is left, so no task holds more
    than ``fan * space`` windows. Each round is written, so a lost executor costs its tasks only.

    Null and empty texts are ``end_id`` alone. Null ids and repeated rows are documents like others. A very long text is
    encoded alone, in bounded memory beyond the text and its ids. Documents of equal length are placed in the order of
    the rows; an empty table gives no rows.
    """
    needed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, rows, held, name = Packer(window, space, slack), [], 0, part << 32
        for doc, ids in document_ids(batches, tokenizer_path, end_id):
            total, data, whole = len(ids), ids.astype("<u4").tobytes(), len(ids) // window * window
            for at in range(0, whole, window):
                rows.append((doc, at, data[4 * at : 4 * (at + window)], total, name, 0, part, False))
                name += 1
            if total > whole:
                for full, pieces in packer.put(name, [(doc, whole, data[4 * whole :], total)], total - whole):
                    rows += _rows(full, pieces, part, False)
                name += 1
            held += 4 * total
            if held > SLICE_BYTES and rows:
                yield _batch(rows)
                rows, held = [], 0
        for full, pieces in packer.open.items():
            rows += _rows(full, pieces, part, True)
        if rows:
            yield _batch(rows)

    packed = stored(needed.mapInArrow(first, SCHEMA), "packed")
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    done, open_rows = packed.where("not open"), packed.where("open")
    after = parts << 32
    while True:
        last = parts <= fan

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            packer, rows, part = Packer(window, space, slack), [], int(key[0])
            for name, pieces, size in _windows(pdf):
                for full, inside in packer.put(name, pieces, size):
                    rows += _rows(full, inside, part, False)
            if last:
                rest = [p for pieces in packer.open.values() for p in pieces]
                for name, inside in last_windows(rest, window, after):
                    rows += _rows(name, inside, part, False)
            else:
                for full, inside in packer.open.items():
                    rows += _rows(full, inside, part, True)
            return pd.DataFrame(rows, columns=NAMES).astype({"doc_id": "Int64"})

        merged = open_rows.groupBy(F.expr(f"part div {fan}").alias("into")).applyInPandas(merge, SCHEMA)
        merged = stored(merged, "packed-merged")
        done = done.unionAll(merged.where("not open"))
        if last:
            break
        parts, open_rows = -(-parts // fan), merged.where("open")
    return done.drop("part", "open")


def assemble(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The training rows: ``sequence_id, n_ids, ids``, padded to ``window`` unless the length is a power of two."""
    pad = pad_id.to_bytes(4, "little")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    whole = pieces.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))
    n = (F.octet_length("ids") / 4).cast("long")
    short = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(window) - n).cast("int")
    padded = F.concat(F.col("ids"), F.unhex(F.repeat(F.lit(pad.hex()), short)))
    return whole.select("sequence_id", n.alias("n_ids"), padded.alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """Lengths and checksums of the pieces' ids."""
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
