"""Secret scans: fixed patterns, and novelty against a zstandard dictionary of the surroundings."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmark.llm.batches import slices

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that make their line and its two neighbours a sensitive context.
_CONTEXT = re.compile(r"password|passwd|secret|token|api[_-]?key|credential|private|bearer|authorization|access[_-]?key", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: The body of a private key, up to its end mark or the end of the text.
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----\s*(.*?)\s*(?:-----END|\Z)", re.DOTALL)
#: Text on both sides of a candidate that primes the dictionary.
AROUND = 1024
#: Outside a sensitive context: least share, and least length of a candidate, which must mix digits and letters of both cases.
ALONE, ALONE_LENGTH = 1.0, 24
#: From so many bytes on the compressor also codes letters by frequency, which takes a quarter off random base64: the least share
#: is then lower by this factor.
CODED_BYTES, CODED_FACTOR = 64, 0.9
#: Identifiers of code and settings that prime every dictionary.
IDENTIFIERS = (
    "access_key access_token account_id api_key api_secret application/json assertEquals authorization aws_access_key_id "
    "aws_secret_access_key base64 bearer certificate client_id client_secret config connection_string content-type "
    "credentials default_token description document endpoint environment example export function github_token identifier "
    "implementation import localhost master_password number parameters password placeholder private_key process.env "
    "public_key refresh_token request response secret_key secret_name self.assertEqual session_token settings signature "
    "string struct test_token token_type undefined username user_password value variable version your_api_key_here "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, not overlapping within a kind, too short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes of a string against identifiers and its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3) -> None:
        import zstandard

        self.zstd, self.identifiers, self.level = zstandard, identifiers.encode(), level

    def share(self, candidate: bytes, around: bytes) -> float:
        """Compressed bytes added by the candidate, as a share of its bytes: near 1 where nothing predicts it."""
        primed = self.zstd.ZstdCompressionDict(self.identifiers + b"\n" + around, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        packer = self.zstd.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        empty = len(packer.compress(b"\n"))
        return (len(packer.compress(b"\n" + candidate)) - empty) / len(candidate)

    def _reaches(self, text: str, start: int, end: int, least: float) -> bool:
        around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]
        return self.share(text[start:end].encode(), around.encode()) >= (least * CODED_FACTOR if end - start >= CODED_BYTES else least)

    def spans(self, text: str, base: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
        """Bodies of private keys, and all candidates of the text, whose share reaches ``least`` in a context, else ``ALONE``.

        A candidate inside base spans is not reported again; one that they only touch is reported as the union with them.
        """
        found, blocks = [], []
        if "PRIVATE KEY-----" in text:
            blocks = [m.span(1) for m in _KEY_BLOCK.finditer(text)]
            found = [(s, 3, e) for s, e in blocks if e > s and self._reaches(text, s, e, least)]
        covered: list[list[int]] = []  # what base spans cover
        for s, _, e in base:
            if covered and s <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        starts, ends = [s for s, _ in covered], [e for _, e in covered]
        near: _Context | None = None
        block = 0
        for m in _CANDIDATE.finditer(text):
            start, end = m.span()
            value = m.group()
            if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                continue
            while block < len(blocks) and blocks[block][1] <= start:
                block += 1
            if block < len(blocks) and blocks[block][0] < end:
                continue
            left, right = start, end
            first, last = bisect_right(ends, start), bisect_left(starts, end)
            if first < last:
                if starts[first] <= start and ends[first] >= end:
                    continue
                left, right = min(start, starts[first]), max(end, ends[last - 1])
                needed = least
            else:
                near = near or _Context(text)
                if near.holds(start, end):
                    needed = least
                elif len(value) >= ALONE_LENGTH and value.lower() != value != value.upper():
                    needed = ALONE
                else:
                    continue
            if self._reaches(text, start, end, needed):
                found.append((left, 3, right))
        return found


class _Context:
    """The lines of a text with a sensitive word, and their neighbours."""

    def __init__(self, text: str) -> None:
        breaks = [m.start() for m in re.finditer("\n", text)]
        self.starts: list[int] = []
        self.ends: list[int] = []
        for m in _CONTEXT.finditer(text):
            i = bisect_left(breaks, m.start())
            start = breaks[i - 2] + 1 if i >= 2 else 0
            end = breaks[i + 1] if i + 1 < len(breaks) else len(text)
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def holds(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The id and the spans of each input row: ``doc_id, spans`` with spans an array of (kind, start, end) in code
    points, by start and then kind. Kinds ``assign, access, hex`` are fixed patterns. ``novel`` ones are bodies of private
    keys, and strings of 16 or more characters with letters and digits, anywhere in the text, whose marginal compressed
    size is at least ``least`` of their length (0.9 of that from 64 characters on) on a line with a sensitive word or next to
    one; elsewhere it must be the whole length, of at least 24 characters with letters of both cases. A string that fixed spans
    touch but do not cover is reported as the union with them. Row-local; a null or empty text has no spans; repeated rows and
    null ids are kept; a very long text is scanned whole, in one pass. A copy of a secret that stands elsewhere in the
    surroundings is no longer novel; the fixed patterns still find it.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                spans = sorted(base + novelty.spans(text, base, least)) if text else []
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans, and all spans as text."""
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        of("novel"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", least: float = 0.8) -> DataFrame:
    """The rows and columns of ``docs`` with every span of the text replaced by ``mark``; overlapping spans as one.

    Null and empty texts and repeated rows stay as they are; only the text column is changed, whatever the others are called.
    """
    # columns by place, as the batch functions of Spark take no names with points
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in slices(batches, name):
            out = []
            for text in batch.column(name).to_pylist():
                if text:
                    base = base_spans(text)
                    spans = sorted(base + novelty.spans(text, base, least))
                    parts, at = [], 0
                    for i, (start, _, end) in enumerate(spans):
                        if start >= at or not i:
                            parts += [text[at:start], mark]
                        at = max(at, end)
                    text = "".join(parts) + text[at:] if spans else text
                out.append(text)
            column = batch.schema.get_field_index(name)
            yield batch.set_column(column, batch.schema.field(column), pa.array(out, batch.schema.field(column).type))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)

