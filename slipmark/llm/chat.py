"""Chat formatting: whole conversations rendered and encoded once, loss masks from offsets by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings. Each is one added token of the tokenizer, so no other token reaches across them.
TURN, TEXT, END = "<turn>", "<text>", "</turn>"


def escape(text: str) -> str:
    """Without ``<``, so that no control or special string can stand in it."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(part.replace("\\l", "<") for part in parts)


def render(turns: list[tuple[str, str]], trained: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the texts of trained roles, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        parts += [head, body, END]
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, rest = piece.partition(TEXT)
        turns.append((unescape(role), unescape(rest[: -len(END)])))
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Flags of the tokens within the spans: both lists are sorted, so each span finds its tokens by binary search."""
    out = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        edges = np.array(spans, dtype=np.int64)
        first = np.searchsorted(offsets[:, 0], edges[:, 0], side="left")
        last = np.searchsorted(offsets[:, 1], edges[:, 1], side="right")
        for a, b in zip(first, last, strict=True):
            out[a:b] = True
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Groups of neighbouring rows with the same id."""
    current, turns, any_yet = None, [], False
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True)
        for conv, role, text in rows:
            if any_yet and conv != current:
                yield current, turns
                turns = []
            current, any_yet = conv, True
            turns.append((role or "", text or ""))
    if any_yet:
        yield current, turns


def format_conversations(
    rows: DataFrame, tokenizer_path: str, trained: tuple[str, ...] = ("assistant",), per_batch: int = 64
) -> DataFrame:
    """One row for each conversation: ``conv_id, formatted, ids, starts, ends, loss_mask``.

    ``rows`` has ``conv_id, turn, role, text``. Turns stand in the order of ``turn``, then role and text; repeated rows
    are repeated turns; null roles and texts are empty; null ids are one conversation. Conversations are dealt by
    their id and read in order, so a task holds one at a time, whole: its encoding is made in one call. ``starts`` and
    ``ends`` are the tokens' offsets in ``formatted``, in code points.
    """
    needed = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    ordered = needed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "formatted", "ids", "starts", "ends", "loss_mask"]
    types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
        roles = frozenset(trained)
        held: list[list] = []
        for conv, turns in _conversations(batches):
            formatted, spans = render(turns, roles)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
            held.append([conv, formatted, encoded.ids, offsets[:, 0], offsets[:, 1], mask(offsets, spans)])
            if len(held) >= per_batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return ordered.mapInArrow(
        run, "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
    )


def runs(starts: list[int], ends: list[int], flags: list[bool]) -> list[list[int]]:
    """Spans that the flagged tokens cover; tokens that meet or share a code point are one span."""
    out: list[list[int]] = []
    for start, end, on in zip(starts, ends, flags, strict=True):
        if on and out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif on:
            out.append([start, end])
    return out


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests, read back from the formatted text and the masked tokens' offsets alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, turns = r["formatted"], parse(r["formatted"])
                loss = "".join(unescape(text[s:e]) for s, e in runs(r["starts"], r["ends"], r["loss_mask"]))
                rows.append([
                    r["conv_id"], len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(r["ids"]),
                ])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    )
