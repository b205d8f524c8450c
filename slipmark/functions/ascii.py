"""The searching steps on Arrow batches of ASCII texts, where a character is a byte; any other text gives null here and takes
the native columns. Rules and draws are those of ``numbers``, ``noise`` and ``draws``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmark.functions import fixed

NUMBER = re.compile(rb"[0-9]++(?:,[0-9]{3})*+(?:\.[0-9]*+)?+")
MARK_DIGITS = len(str(fixed.MAX_STEP_NUMBER))
BLANK = np.array([x < 128 and chr(x).isspace() for x in range(256)])
STEP_SENTENCE, LETTERS = fixed.STEP_SENTENCE.encode(), fixed.LETTERS.encode()
IS_LETTER = np.array([x < 128 and chr(x).isalpha() for x in range(256)])


def _raw(text: Column) -> Column:
    return text.cast("string").cast("binary")


def _rows(*columns: pa.Array) -> Iterable:
    return zip(*[c.to_pylist() for c in columns], strict=True)


def _lists(sizes, values: pa.Array) -> pa.Array:
    """Lists of the given sizes over ``values``, null where there is no size."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(np.array([n or 0 for n in sizes], dtype=np.int32), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([n is None for n in sizes], pa.bool_()))


def _strings(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _ints(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int32))


def boundary(text: bytes) -> int:
    at = text.find(STEP_SENTENCE)
    return 0 if at < 0 else at + len(STEP_SENTENCE)


class _Numbers:
    """The numbers of all ASCII texts of a batch, which are joined to one buffer: ``row``, begin ``a`` and end ``b`` there, ``i`` in the text."""

    def __init__(self, texts: list[bytes | None]):
        self.ok = [t is not None and t.isascii() for t in texts]
        self.texts = [t if ok else b"" for t, ok in zip(texts, self.ok, strict=True)]
        self.buffer = np.frombuffer(b"\0" + b"\0".join(self.texts) + b"\0", dtype=np.uint8)
        sizes = np.array([len(t) + 1 for t in self.texts], dtype=np.int64)
        self.base = np.concatenate([[1], 1 + np.cumsum(sizes)[:-1]]).astype(np.int64) if texts else np.ones(0, dtype=np.int64)
        self.digit = (self.buffer - 48) < 10
        self._find()
        self.first = np.searchsorted(self.row, np.arange(len(texts)))
        self.i = np.arange(len(self.row)) - self.first[self.row]

    def _find(self) -> None:
        """Runs of digits; one behind a comma with three digits, or behind a point, is part of the number before. Texts where a run
        after such a point goes on, or one after a comma is longer, are searched with the pattern."""
        edges = np.flatnonzero(self.digit[1:] != self.digit[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        row = np.searchsorted(self.base, start, "right") - 1
        beside = np.zeros(len(start), dtype=bool)
        beside[1:] = start[1:] - end[:-1] == 1
        comma, point = beside & (self.buffer[start - 1] == 44), beside & (self.buffer[start - 1] == 46)
        odd = comma & (end - start > 3)
        odd[1:] |= point[:-1] & (comma | point)[1:]
        odd_rows = np.unique(row[odd])
        if len(odd_rows):
            kept = ~np.isin(row, odd_rows)
            start, end, row, comma, point = (x[kept] for x in (start, end, row, comma, point))
        head = np.flatnonzero(~(point | comma & (end - start == 3)))
        last = np.append(head[1:], len(start))[: len(head)] - 1
        self.row, self.a = row[head], start[head]
        self.b = end[last] + (~point[last] & (self.buffer[end[last]] == 46))
        if len(odd_rows):
            more = [(r, *m.span()) for r in odd_rows.tolist() for m in NUMBER.finditer(self.texts[r])]
            more_row, more_a, more_b = np.array(more, dtype=np.int64).reshape(-1, 3).T
            row, a, b = (np.concatenate(x) for x in ((self.row, more_row), (self.a, self.base[more_row] + more_a), (self.b, self.base[more_row] + more_b)))
            order = np.argsort(a, kind="stable")
            self.row, self.a, self.b = row[order], a[order], b[order]

    def words(self, of=slice(None)) -> pa.Array:
        a, sizes = self.a[of], (self.b - self.a)[of]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - sizes), sizes)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(self.buffer[at])])

    def values(self, words: pa.Array) -> np.ndarray:
        plain = pc.replace_substring(words, ",", "")
        try:
            return plain.cast(pa.float64()).to_numpy(zero_copy_only=False)
        except pa.ArrowInvalid:  # beyond a double
            return np.array([float(x) for x in plain.to_pylist()], dtype=np.float64)

    def before(self, start: np.ndarray) -> np.ndarray:
        """How many numbers each text has before its place ``start``."""
        border = (self.base + start)[self.row]
        count = np.bincount(self.row[self.a < border], minlength=len(self.texts))
        for r in np.unique(self.row[(self.a < border) & (self.b > border)]).tolist():  # a border inside a number
            count[r] = sum(1 for _ in NUMBER.finditer(self.texts[r], 0, int(start[r])))
        return np.where(start > 0, count, 0)

    def step_marks(self, start: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Which numbers are step markers to mask, as ``numbers._masked_marks`` has them: marker by marker for all texts."""
        out = np.zeros(len(self.row), dtype=bool)
        width = self.b - self.a - 1
        m = np.flatnonzero((width > 0) & (width <= MARK_DIGITS) & (self.buffer[self.b - 1] == 46) & BLANK[self.buffer[self.b]])
        a, b = self.a[m], self.b[m] - 1
        good = (self.buffer[a] != 48) & ((a == self.base[self.row[m]]) | BLANK[self.buffer[a - 1]])
        n = np.zeros(len(m), dtype=np.int64)
        for k in range(MARK_DIGITS):
            inside, x = a + k < b, np.minimum(a + k, b)
            good &= ~inside | self.digit[x]
            n = np.where(inside, n * 10 + self.buffer[x] - 48, n)
        m, n = m[good], n[good]
        order = np.lexsort((m, n))
        m, n = m[order], n[order]
        tail = np.minimum(self.base + start, len(self.buffer) - 3)
        edge = (start > 0) & (self.buffer[tail] == 49) & (self.buffer[tail + 1] == 46) & BLANK[self.buffer[tail + 2]]
        alive, after, level = np.ones(len(self.texts), dtype=bool), skip - 1, 1
        while True:
            these = m[np.searchsorted(n, level) : np.searchsorted(n, level, "right")]
            these = these[alive[self.row[these]]]
            if not len(these):
                return out
            rows, firsts = np.unique(self.row[these], return_index=True)
            hits = these[self.i[these] > after[self.row[these]]]
            hits = hits[np.unique(self.row[hits], return_index=True)[1]]
            if level == 1:
                hits = np.concatenate([hits[~edge[self.row[hits]]], (self.first + skip)[rows[edge[rows]]]])
            out[hits] = True
            alive = np.zeros(len(self.texts), dtype=bool)
            alive[rows], after, level = True, after.copy(), level + 1
            after[rows] = self.i[these[firsts]]

    def counts(self, of=slice(None)) -> list[int | None]:
        """How many of the numbers ``of`` each text has; null for texts that are not ASCII."""
        sizes = np.bincount(self.row[of], minlength=len(self.texts)).tolist()
        return [n if ok else None for n, ok in zip(sizes, self.ok, strict=True)]


def mask_step_numbers(text: Column, start: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, starts: pa.Array) -> pa.Array:
        known = [t if at is not None else None for t, at in _rows(texts, starts)]
        found, start = _Numbers(known), np.array(starts.fill_null(0), dtype=np.int64)
        out = found.buffer.copy()
        marks = np.flatnonzero(found.step_marks(start, found.before(start)))
        a, b, row = found.a[marks], found.b[marks], found.row[marks]
        own = np.where(found.i[marks] > 0, found.b[marks - 1], found.base[row])  # where the text before the number begins
        out[a[(a > own) & BLANK[found.buffer[a - 1]]] - 1] = 32
        for k in range(MARK_DIGITS):
            out[(a + k)[a + k < b - 1]] = 64
        out[b] = 32
        whole = out.tobytes()
        touched = set(row.tolist())
        return _strings([
            None if not ok else t if r not in touched else whole[at : at + len(t)]
            for r, (t, ok, at) in enumerate(zip(found.texts, found.ok, found.base.tolist(), strict=True))
        ])

    return run(_raw(text), start.cast("int"))


def number_tokens(text: Column) -> Column:
    @F.arrow_udf("array<struct<idx:int,start:int,`end`:int,text:string,value:double>>")
    def run(texts: pa.Array) -> pa.Array:
        found = _Numbers(texts.to_pylist())
        words, base = found.words(), found.base[found.row]
        columns = [_ints(found.i), _ints(found.a - base), _ints(found.b - base), words, pa.array(found.values(words), pa.float64())]
        return _lists(found.counts(), pa.StructArray.from_arrays(columns, ["idx", "start", "end", "text", "value"]))

    return run(_raw(text))


def number_occurrences(text: Column) -> Column:
    @F.arrow_udf("array<struct<first_start:int,value:double,n:int,starts:array<int>>>")
    def run(texts: pa.Array) -> pa.Array:
        found = _Numbers(texts.to_pylist())
        value = found.values(found.words())
        order = np.lexsort((value, found.row))  # by text, value and place
        row, value, start = found.row[order], value[order], (found.a - found.base[found.row])[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        heads = np.flatnonzero(new)
        sizes = np.append(heads[1:], len(row))[: len(heads)] - heads
        groups = _lists(sizes, _ints(start))
        by_place = np.lexsort((start[heads], row[heads]))
        at = heads[by_place]
        columns = [_ints(start[at]), pa.array(value[at], pa.float64()), _ints(sizes[by_place]), groups.take(pa.array(by_place))]
        made = pa.StructArray.from_arrays(columns, ["first_start", "value", "n", "starts"])
        return _lists(found.counts(order[heads]), made)

    return run(_raw(text))


class _Candidates(_Numbers):
    """The numbers that are not masked (``p`` counts these in a text), by text, value and place."""

    def __init__(self, texts: list[bytes | None], remove_steps: bool):
        super().__init__(texts)
        self.start = np.array([boundary(t) for t in self.texts], dtype=np.int64)
        skip = self.before(self.start)
        live = np.flatnonzero(~self.step_marks(self.start, skip)) if remove_steps else np.arange(len(self.row))
        row = self.row[live]
        self.p = np.zeros(len(self.row), dtype=np.int64)
        self.p[live] = np.arange(len(live)) - np.searchsorted(row, np.arange(len(texts)))[row]
        self.usable = self.i >= skip[self.row]
        wide = np.flatnonzero(self.b - self.a > 6)  # a number with a comma and decimals has no changed form
        self.usable[wide[np.array(pc.match_substring_regex(self.words(wide), r",.*\.[0-9]"), dtype=bool)]] = False
        value = self.values(self.words(live))
        order = np.lexsort((value, row))
        self.live, self.sorted, row, value = live, live[order], row[order], value[order]
        same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
        self.repeats, self.follows = np.zeros(len(row), dtype=bool), np.zeros(len(row), dtype=bool)
        self.repeats[1:], self.follows[:-1] = same, same

    def of(self, position: str) -> tuple[np.ndarray, np.ndarray | None]:
        """The candidates of a position by text, with the second places of ``propcalc``."""
        if position == "any":
            return self.live[self.usable[self.live]], None
        keep = {"calc": ~self.repeats, "copy": self.repeats, "propcalc": ~self.repeats & self.follows}[position]
        at = np.flatnonzero(keep & self.usable[self.sorted])
        return self.sorted[at], self.sorted[at + 1] if position == "propcalc" else None


def candidates(text: Column, positions: tuple[str, ...], remove_steps: bool) -> Column:
    """A struct with the candidates of each position, as ``numbers.candidates_by_position`` lists them."""
    each = "array<struct<idx:int,number:string,partner_idx:int>>"

    @F.arrow_udf(f"struct<{','.join(f'`{p}`:{each}' for p in positions)}>")
    def run(texts: pa.Array) -> pa.Array:
        found = _Candidates(texts.to_pylist(), remove_steps)
        lists = []
        for position in positions:
            at, second = found.of(position)
            partner = pa.nulls(len(at), pa.int32()) if second is None else _ints(found.p[second])
            rows = pa.StructArray.from_arrays([_ints(found.p[at]), found.words(at), partner], ["idx", "number", "partner_idx"])
            lists.append(_lists(found.counts(at), rows))
        return pa.StructArray.from_arrays(lists, list(positions), mask=pa.array([not ok for ok in found.ok], pa.bool_()))

    return run(_raw(text))


def _drawn(key: bytes | None, seed: str) -> Callable[[bytes, int], int]:
    """``draws.draw`` of one row."""
    head = b"".join(part + b"|" for part in (seed.encode(), key) if part is not None)
    return lambda purpose, i: int.from_bytes(md5(b"%b%b|%d" % (head, purpose, i)).digest()[:4], "big")


def _positions(draw: Callable[[bytes, int], int], n: int, size: int) -> list[int]:
    """``draws.sample_positions`` of one row."""
    ranks = [draw(b"letters", i) % max(n - i, 1) for i in range(size)]
    out = []
    for i, r in enumerate(ranks):
        for earlier in reversed(ranks[:i]):
            r += r >= earlier
        out.append(r)
    return out


class _Letters:
    """The letters of a batch of texts, which are joined to one buffer."""

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.places = np.flatnonzero(IS_LETTER[self.buffer])
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[: len(texts)]
        self.first = np.searchsorted(self.places, self.begins)
        self.n = (np.searchsorted(self.places, self.ends) - self.first).tolist()

    def put(self, rows: list[int], letters: list[int], drawn: list[int]) -> bytes:
        """The buffer with the drawn letters at the places of ``letters`` of the texts ``rows``."""
        out = self.buffer.copy()
        at = self.first[np.array(rows, dtype=np.int64)] + np.array(letters, dtype=np.int64)
        out[self.places[at]] = np.frombuffer(LETTERS, dtype=np.uint8)[np.array(drawn, dtype=np.int64)]
        return out.tobytes()


def chosen_number(key: Column, text: Column, position: str, remove_steps: bool, seed: str, noise=None) -> Column:
    """Boundary of the text, place of the drawn candidate, and the second place of ``propcalc``; places are null without any.

    With ``noise`` (``noise.matched_noise``) also the text before the candidate and between both places, with changed letters:
    a changed number has no letters, so these hold all of the outputs, and null stands for too few.
    """
    names = ["start", "from1", "to1", "from2", "to2"]
    more = ["head", "middle"] if noise else []

    def noisy(keys: list, heads: list[bytes], middles: list[bytes]) -> tuple[list, list]:
        found = _Letters([a + b for a, b in zip(heads, middles, strict=True)])
        rows, letters, drawn = [], [], []
        for r, (k, n) in enumerate(zip(keys, found.n, strict=True)):
            if n > noise.count:
                draw = _drawn(k, noise.seed)
                chosen = [p + 1 for p in _positions(draw, n, noise.count) if p + 1 < n]
                rows += [r] * len(chosen)
                letters += chosen
                drawn += [draw(b"letter:all", p) % 26 for p in chosen]
        whole = found.put(rows, letters, drawn)
        cuts = [(a, a + len(h), b) if n > noise.count else None
                for a, b, h, n in zip(found.begins.tolist(), found.ends.tolist(), heads, found.n, strict=True)]
        return [c and whole[c[0] : c[1]] for c in cuts], [c and whole[c[1] : c[2]] for c in cuts]

    @F.arrow_udf(f"struct<{','.join(f'{n}:int' for n in names)}{''.join(f',{n}:string' for n in more)}>")
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        found = _Candidates(texts.to_pylist(), remove_steps)
        at, second = found.of(position)
        sizes = np.bincount(found.row[at], minlength=len(texts))
        rows = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[rows]
        known = keys.take(pa.array(rows)).to_pylist()
        pick = first + np.array([_drawn(k, seed)(b"place", 0) for k in known], dtype=np.int64) % sizes[rows]
        places = []
        for chosen in (at, second):
            for side in (found.a, found.b):
                place = np.full(len(texts), -1, dtype=np.int64)
                if chosen is not None:
                    place[rows] = side[chosen[pick]] - found.base[rows]
                places.append(place)
        columns = [_ints(found.start), *[pa.array(x.astype(np.int32), mask=x < 0) for x in places]]
        if noise:
            inside = lambda a, b: [found.texts[r][x:y] for r, x, y in zip(rows.tolist(), a[rows].tolist(), b[rows].tolist(), strict=True)]
            heads = inside(found.start, places[0])
            made = noisy(known, heads, inside(places[1], places[2]) if second is not None else [b""] * len(heads))
            index = np.full(len(texts), -1, dtype=np.int64)
            index[rows] = np.arange(len(rows))
            columns += [_strings(x).take(pa.array(index, mask=index < 0)) for x in made]
        return pa.StructArray.from_arrays(columns, names + more, mask=pa.array([not ok for ok in found.ok], pa.bool_()))

    return run(_raw(key), _raw(text))


def letter_noise(key: Column, text: Column, parts: list[tuple[str, int]], seed: str) -> Column:
    """The text of each part, stripped; no texts where there are not more letters than the largest part draws."""
    most = max(count for _, count in parts)

    @F.arrow_udf("array<string>")
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        known = texts.to_pylist()
        ok = [t is not None and t.isascii() for t in known]
        found = _Letters([t[boundary(t) :] if fine else b"" for t, fine in zip(known, ok, strict=True)])
        rows: list[list[int]] = [[] for _ in parts]
        letters, drawn = [[] for _ in parts], [[] for _ in parts]
        for r, (k, n) in enumerate(zip(keys.to_pylist(), found.n, strict=True)):
            if n <= most:
                continue
            draw = _drawn(k, seed)
            positions = _positions(draw, n, most)
            for i, (name, count) in enumerate(parts):
                chosen = [p + 1 for p in positions[: count + 1] if p + 1 < n]
                purpose = f"letter:{name}".encode()
                rows[i] += [r] * len(chosen)
                letters[i] += chosen
                drawn[i] += [draw(purpose, p) % 26 for p in chosen]
        made = [found.put(*x).decode("ascii") for x in zip(rows, letters, drawn, strict=True)]
        enough = [(a, b) for a, b, n in zip(found.begins.tolist(), found.ends.tolist(), found.n, strict=True) if n > most]
        out = [whole[a:b].strip() for a, b in enough for whole in made]
        return _lists([None if not fine else len(parts) if n > most else 0 for fine, n in zip(ok, found.n, strict=True)], pa.array(out, pa.string()))

    return run(_raw(key), _raw(text))
