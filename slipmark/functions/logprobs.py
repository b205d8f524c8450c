"""Log-probability of a target answer from recorded tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmark.functions.fixed import BLANKS, END_OF_TEXT

#: How many tokens up to one must equal the tail of the explanation.
TAIL = 5
_PLAIN = np.array([32 < x < 127 for x in range(256)])
_ASCII_BLANKS = "".join(c for c in BLANKS if c.isascii()).encode()


def _flat(lists: pa.Array, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """The entries of all lists, one after the other, and where each list begins; a null list has none."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return lists.flatten().cast(kind), offsets


def _strip(text: bytes) -> bytes:
    if text.isascii():
        return text.strip(_ASCII_BLANKS)
    return text.decode("utf-8", "surrogateescape").strip(BLANKS).encode("utf-8", "surrogateescape")


class _Tokens:
    """Bytes of the tokens of all rows of a batch in one buffer, token ``j`` from ``at[j]`` to ``at[j + 1]``."""

    def __init__(self, lists: pa.Array):
        values, self.first = _flat(lists, pa.large_string())
        self.null = values.is_null().to_numpy(zero_copy_only=False)
        values = values.fill_null("")
        _, offsets, data = values.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int64)
        self.text = b"" if data is None else data.to_pybytes()[at[0] : at[-1]]
        self.at = at - at[0]
        ends = np.flatnonzero(pc.equal(values, END_OF_TEXT).to_numpy(zero_copy_only=False))
        self.last = self.first[1:].copy()
        np.minimum.at(self.last, np.searchsorted(self.first, ends, "right") - 1, ends)

    def may_end(self, explanations: list[bytes | None]) -> np.ndarray:
        """Tokens that the explanation of their row can end with, by their last two bytes; blank and other odd ones may always."""
        buffer = np.frombuffer(b"\0\0" + self.text, dtype=np.uint8)
        size, end = np.diff(self.at), self.at[1:] + 2
        row = np.repeat(np.arange(len(self.last)), np.diff(self.first))
        known = np.array([e is not None for e in explanations], dtype=bool)
        tail = np.frombuffer(b"".join((b"\0\0" + (e or b""))[-2:] for e in explanations), dtype=np.uint8).reshape(-1, 2)
        last, before = buffer[end - 1], buffer[end - 2]
        plain = (size > 0) & _PLAIN[last]
        out = known[row] & ~self.null & (np.arange(len(size)) < self.last[row])
        out &= ~plain | (last == tail[row, 1])
        return out & (~plain | (size < 2) | ~_PLAIN[before] | (before == tail[row, 0]))


def _found(token_lists: pa.Array, logprob_lists: pa.Array, explanations: pa.Array, targets: pa.Array) -> pa.Array:
    tokens = _Tokens(token_lists)
    values, base = _flat(logprob_lists, pa.float64())
    missing, values, sizes, base = values.is_null().to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False), np.diff(base).tolist(), base.tolist()
    stripped, wanted = [e if e is None else _strip(e) for e in explanations.to_pylist()], targets.to_pylist()
    sums, texts, counts = [0.0] * len(wanted), [b""] * len(wanted), [0] * len(wanted)
    places = np.flatnonzero(tokens.may_end(stripped))
    rows = np.searchsorted(tokens.first, places, "right") - 1
    begins, ends = tokens.at[np.maximum(tokens.first[rows], places - TAIL + 1)].tolist(), tokens.at[places + 1].tolist()
    firsts, lasts, text, done = tokens.first[rows].tolist(), tokens.last[rows].tolist(), tokens.text, -1
    for j, row, first, last, begin, end in zip(places.tolist(), rows.tolist(), firsts, lasts, begins, ends, strict=True):
        if row == done:
            continue
        seen = _strip(text[begin:end])
        if not (stripped[row].endswith(seen) if seen else not stripped[row]):
            continue
        done, target = row, wanted[row]
        if target is None:
            continue
        answer, total, n = b"", 0.0, 0
        for i in range(j + 1, last):
            if target in answer:
                break
            token = text[tokens.at[i] : tokens.at[i + 1]]
            word = _strip(token)
            if (n or word) and word in target and not tokens.null[i]:
                at = base[row] + i - first
                known = i - first < sizes[row] and not missing[at]
                answer, n = answer + token, n + 1
                total = total + float(values[at]) if known and total is not None else None
        sums[row], texts[row], counts[row] = total, answer, n
    columns = [pa.array(sums, pa.float64()), pa.array(texts, pa.binary()).view(pa.string()), pa.array(counts, pa.int32())]
    unknown = pc.or_(token_lists.is_null(), logprob_lists.is_null())
    return pa.StructArray.from_arrays(columns, ["logprob", "answer_text", "n_tokens"], mask=unknown)


def target_logprob(tokens: Column, logprobs: Column, explanation: Column, target: Column) -> Column:
    """struct<logprob, answer_text, n_tokens>: the tokens after the explanation that make up the target.

    The answer starts after the first token at which the last five tokens equal the tail of the explanation. Blank
    tokens before the answer and tokens that are no part of the target are skipped; counting ends once the target
    is complete or at the end-of-text token. Null where a list is null; a null explanation or target has no answer.
    """
    return record_logprob(F.struct(
        tokens.cast("array<string>").alias("tokens"), logprobs.cast("array<double>").alias("logprobs"),
        explanation.cast("string").alias("explanation"), target.cast("string").alias("target")))


def record_logprob(record: Column) -> Column:
    """``target_logprob`` of a struct with these four fields."""

    @F.arrow_udf("struct<logprob:double,answer_text:string,n_tokens:int>")
    def found(records: pa.Array) -> pa.Array:
        tokens, logprobs, explanations, targets = (pc.struct_field(records, x) for x in ("tokens", "logprobs", "explanation", "target"))
        return _found(tokens, logprobs, explanations.cast(pa.binary()), targets.cast(pa.binary()))

    return found(record)
