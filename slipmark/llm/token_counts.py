"""Token counts by a finite-state transducer whose chunk state maps are composed by a prefix scan."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmark.llm.batches import slices, span_hashes, text_bytes

#: Code points in a chunk whose state map is computed for every entry state.
CHUNK = 64
#: Pieces whose counts a task remembers; beyond that it forgets them all and starts again.
REMEMBERED = 1 << 20
#: Bytes of text that a scan covers, and new pieces given to the tokenizer at once.
SCAN_BYTES, NEW_PIECES = 1 << 19, 1 << 11

# Symbols that the transducer reads: class of the code point, with what the split pattern looks ahead to folded in.
_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE, _LAST_BLANK, _LAST_WHITE, _SHORT, _LONG, _BREAK = range(10)
# States: the class of the code point before, or how many letters of a contraction are still to come.
_START, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _AFTER_BLANK, _IN_WHITE, _ONE_MORE, _TWO_MORE = range(8)
_STATES = 8
# white space outside the ASCII range, and the ASCII one
_WHITE_POINTS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Transitions ``next[state, symbol]`` and the number of pieces, 0 or 1, that each one begins.

    Pieces are: a contraction, ``'s 't 'm 'd 're 've 'll``, where a piece may begin; letters, numbers or others with
    one blank before them; white space without its last one where something follows; a last white space.
    """
    to = np.zeros((_STATES, 10), dtype=np.uint8)
    emits = np.zeros((_STATES, 10), dtype=np.uint8)
    runs = {_LETTER: _IN_LETTERS, _NUMBER: _IN_NUMBERS, _OTHER: _IN_OTHERS}
    for state in range(_STATES):
        for symbol in range(10):
            if symbol == _BREAK:  # the first code point of a text is never within a piece of the one before
                to[state, symbol], emits[state, symbol] = _START, 0
            elif symbol in (_BLANK, _WHITE):  # white space that more white space, or the end, follows
                to[state, symbol], emits[state, symbol] = _IN_WHITE, state not in (_IN_WHITE,)
            elif symbol in (_LAST_BLANK, _LAST_WHITE):  # the last one before something else begins a piece
                to[state, symbol] = _AFTER_BLANK if symbol == _LAST_BLANK else _START
                emits[state, symbol] = 1
            elif state == _TWO_MORE:
                to[state, symbol] = _ONE_MORE
            elif state == _ONE_MORE:
                to[state, symbol] = _START
            elif symbol in (_SHORT, _LONG):
                if state in (_IN_OTHERS, _AFTER_BLANK):  # within a run of others no contraction begins
                    to[state, symbol], emits[state, symbol] = _IN_OTHERS, 0
                else:
                    to[state, symbol] = _ONE_MORE if symbol == _SHORT else _TWO_MORE
                    emits[state, symbol] = 1
            else:
                to[state, symbol] = runs[symbol]
                emits[state, symbol] = state not in (runs[symbol], _AFTER_BLANK)
    return to, emits


_TO, _EMITS = _compile()


class _Classes:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            kinds = {"L": _LETTER, "N": _NUMBER}
            cls.table = np.array([kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)], dtype=np.uint8)
            cls.table[_WHITE_POINTS] = _WHITE
            cls.table[0x20] = _BLANK
        return cls.table


def symbols(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """What the transducer reads for each code point. Texts are separated: each begins with a code point 0 of its own."""
    kind = _Classes.get()[points]
    breaks = np.zeros(len(points) + 1, dtype=bool)
    breaks[text_starts] = True
    breaks[-1] = True
    white = (kind == _BLANK) | (kind == _WHITE)
    white[text_starts[text_starts < len(points)]] = False
    ahead = np.zeros(len(points), dtype=bool)  # something other than white space follows in the same text
    ahead[:-1] = ~white[1:] & ~breaks[1:-1]
    out = kind.copy()
    out[white & ahead & (kind == _BLANK)] = _LAST_BLANK
    out[white & ahead & (kind == _WHITE)] = _LAST_WHITE
    at = np.flatnonzero(points == 0x27)
    if len(at):
        follow = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
        after = np.concatenate([breaks, np.ones(2, dtype=bool)])
        one, two = follow[at + 1], follow[at + 2]
        near, far = ~after[at + 1], ~after[at + 1] & ~after[at + 2]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        pairs = (one.astype(np.int64) << 21) | two
        long = far & np.isin(pairs, [(ord(a) << 21) | ord(b) for a, b in ("re", "ve", "ll")])
        out[at[short]] = _SHORT
        out[at[long]] = _LONG
    out[text_starts[text_starts < len(points)]] = _BREAK
    return out


def scan(read: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a piece begins.

    The state map of each chunk (exit state for every entry state) is computed for all chunks at once; maps are composed
    by a parallel prefix scan, which doubles the reach in each round; then each chunk runs once from its known entry.
    """
    n = len(read)
    if not n:
        return np.empty(0, dtype=bool)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, _BREAK, dtype=np.uint8)
    padded[:n] = read
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    flat_to, flat_emits = _TO.ravel(), _EMITS.ravel()
    maps = np.empty((chunks, _STATES), dtype=np.uint8)
    for entry in range(_STATES):
        state = np.full(chunks, entry, dtype=np.uint8)
        for column in columns:
            state = flat_to.take(state * np.uint8(10) + column)
        maps[:, entry] = state
    reach = 1
    while reach < chunks:  # maps[i] becomes the map of the chunks up to i
        earlier = maps[:-reach].copy()
        maps[reach:] = np.take_along_axis(maps[reach:], earlier, axis=1)
        reach *= 2
    state = np.empty(chunks, dtype=np.uint8)
    state[0] = _START
    state[1:] = maps[:-1, _START]
    begins = np.empty((CHUNK, chunks), dtype=np.uint8)
    for i, column in enumerate(columns):
        at = state * np.uint8(10) + column
        begins[i] = flat_emits.take(at)
        state = flat_to.take(at)
    return np.ascontiguousarray(begins.T).ravel()[:n].astype(bool)


class Lexicon:
    """Emitted-token counts of whole pieces, filled from the tokenizer the first time a piece is met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys = np.empty(0, dtype=np.uint64)
        self.counts = np.empty(0, dtype=np.int64)

    def tokens(self, texts: list[str]) -> list[int]:
        """Counts of the library itself. Its encodings are large, so few are held at once."""
        out = []
        for i in range(0, len(texts), NEW_PIECES):
            out += [len(e) for e in self.tokenizer.encode_batch_fast(texts[i : i + NEW_PIECES], add_special_tokens=False)]
        return out

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of the pieces data[starts:ends]."""
        hashes = span_hashes(data, starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        out = np.zeros(len(unique), dtype=np.int64)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        out[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            pieces = [data[starts[i] : ends[i]].tobytes().decode("utf-8") for i in first[new]]
            out[new] = self.tokens(pieces)
            if len(self.keys) + len(new) > REMEMBERED:
                self.keys, self.counts = unique, out
            else:
                keys = np.concatenate([self.keys, unique[new]])
                order = np.argsort(keys, kind="stable")
                self.keys, self.counts = keys[order], np.concatenate([self.counts, out[new]])[order]
        return out[back]


def _counts(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    # a code point 0 before each text: it breaks pieces, and is not counted
    lead = np.zeros(len(data) + n, dtype=np.uint8)
    moved = offsets[:-1] + np.arange(n)
    keep = np.ones(len(lead), dtype=bool)
    keep[moved] = False
    lead[keep] = data
    points = np.frombuffer(lead.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    byte_at = np.flatnonzero((lead & 0xC0) != 0x80)  # first byte of each code point
    text_starts = np.searchsorted(byte_at, moved)
    begins = scan(symbols(points, text_starts))
    breaks = np.zeros(len(points), dtype=bool)
    breaks[text_starts] = True
    starts = byte_at[begins]
    edges = np.flatnonzero(begins | breaks)
    following = np.concatenate([byte_at[edges[1:]], [len(lead)]]) if len(edges) else np.empty(0, dtype=np.int64)
    ends = following[begins[edges]]
    found = lexicon.count(lead, starts, ends) if len(starts) else np.empty(0, dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(found)])
    first = np.searchsorted(starts, np.concatenate([moved, [len(lead)]]))
    tokens = sums[first[1:]] - sums[first[:-1]]
    if lexicon.special:  # texts that hold a special string are cut at it by the library
        import pyarrow.compute as pc

        for special in lexicon.special:
            hits = pc.match_substring(column.cast(pa.large_string()).fill_null(""), special).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(hits):
                tokens[i] = lexicon.tokens([column[int(i)].as_py()])[0]
    return np.diff(offsets), tokens


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    The split pattern of byte-level tokenizers is compiled into a deterministic transducer over code point classes. It
    runs over a slice of many texts in chunks of ``CHUNK`` code points, all entry states at once, and the state maps are
    composed by a prefix scan. A piece's merges are not finite-state over pieces of any length, so the last transition
    of a piece takes its emitted-token count from a lexicon that the tokenizer fills for each new piece. Null and empty
    texts have 0 tokens; rows keep their order and number; null ids stay null; other columns are ignored. Each executor reads the
    vocabulary file from ``tokenizer_path``.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(tokenizer_path)
        for batch in slices(batches, "text", SCAN_BYTES):
            n_bytes, tokens = _counts(batch.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
