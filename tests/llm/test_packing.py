"""Packing: ids equal to the library's whole texts, every id in one piece, little padding, and bounded windows."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slipmark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


ODD = st.sampled_from([
    "'s", "''s", "'RE", "don't", "é", "É", "é", "́", "≮", "×", "÷", "ß", "ﬁ", "İ", " ", "　", "\x1c", "\x0b",
    "<|endoftext|>", "<|startoftext|", "½", "٣", "中文", "한", "ж", "“", "…", "🙂", "👩‍👩", "\r\n", "\t", " ", "  ", "a", "Zq", "7", "42", ".,", "$", "\x00",
])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=3)), max_size=25).map("".join), st.text(max_size=8))
def test_ids_are_the_librarys(text, other):
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array([text, None, other], pa.large_string())], ["doc_id", "text"])
    found = [(row, ids.tolist()) for row, ids in packing.document_ids(iter([batch]), PATH, 1)]
    assert found == [(1, library_ids(text)), (None, [1]), (3, library_ids(other))]


def test_lexicon_begins_anew(monkeypatch):
    monkeypatch.setattr(packing, "LEXICON_BYTES", 1000)
    lex = packing.Lexicon(PATH)
    for i in range(20):
        text = " ".join(f"word{j}x{i}" for j in range(30)) + " " + "y" * 500
        data = np.frombuffer(text.encode(), np.uint8)
        ids, at = lex.encode_slice(data, np.array([0, len(data)]))
        assert [*ids.tolist(), 1] == library_ids(text) and at.tolist() == [0, len(ids)]
        assert lex.kept <= 1000


def check(spark, rows, window, **how):
    """All pieces of ``rows`` (id, text), after checking them against the library."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, PATH, window=window, **how)
    found = pieces.collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    expected = {}
    for i, text in rows:
        expected.setdefault(i, []).append(library_ids(text))
    assert by_doc.keys() == expected.keys()
    for i, texts in expected.items():
        mine = sorted(by_doc[i], key=lambda r: (r.doc_tokens, r.start))
        assert {r.doc_tokens for r in mine} == {len(t) for t in texts}
        if len(texts) == 1:
            ids = b"".join(bytes(r.ids) for r in mine)
            assert [r.start for r in mine] == [sum(len(q.ids) // 4 for q in mine[:k]) for k in range(len(mine))]
            assert ids == struct.pack(f"<{len(texts[0])}I", *texts[0])
        else:
            assert sum(len(r.ids) for r in mine) == 4 * sum(map(len, texts))
    windows = {}
    for r in found:
        windows.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for inside in windows.values():
        inside.sort(key=lambda r: r.offset)
        at = 0
        for r in inside:
            assert r.offset == at and len(r.ids) > 0
            at += len(r.ids) // 4
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    digests = {(r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in packing.digest(pieces).collect()}
    assert digests == {(r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(bytes(r.ids)), r.sequence_id, r.offset) for r in found}
    return found, windows, padding


def test_pieces_and_padding(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word", "cat", "x"][k] for k in rng.integers(0, 3, rng.integers(0, 150)))) for i in range(600)]
    rows += [(601, None), (602, ""), (603, "cat " * 5000)]
    found, windows, padding = check(spark, rows, 64, space=8, slack=2)
    total = sum(len(r.ids) // 4 for r in found)
    assert padding <= 2 * len(windows) and total <= 64 * len(windows) <= 1.1 * total


def test_many_partitions_take_rounds(spark):
    docs = [(i, "cat " * (i % 40)) for i in range(300)]
    wide = spark.createDataFrame(docs, "doc_id long, text string").repartition(30)
    pieces = packing.pack(wide, PATH, window=32, space=2, slack=1, fan=3).collect()
    assert sorted((r.doc_id, r.start + k) for r in pieces for k in range(len(r.ids) // 4)) == sorted(
        (i, k) for i, t in docs for k in range(len(library_ids(t))))
    filled = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + len(r.ids) // 4
    short = [n for n in filled.values() if n < 31]
    assert max(filled.values()) <= 32 and len(short) <= 5 and all(n & (n - 1) == 0 for n in short)


def test_assembled_rows(spark):
    docs = spark.createDataFrame([(i, "cat dog " * (3 * i)) for i in range(30)], "doc_id long, text string")
    pieces = packing.pack(docs, PATH, window=32, space=4, slack=2)
    whole = {r.sequence_id: r for r in packing.assemble(pieces, 32, pad_id=7).collect()}
    for r in pieces.collect():
        line = bytes(whole[r.sequence_id].ids)
        assert line[4 * r.offset : 4 * r.offset + len(r.ids)] == bytes(r.ids)
    for r in whole.values():
        ids = struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids))
        power = r.n_ids & (r.n_ids - 1) == 0
        assert len(ids) == (r.n_ids if power else 32) and set(ids[r.n_ids :]) <= {7}


@pytest.mark.parametrize("rows", [[], [(None, None)], [(5, "a"), (5, "a"), (None, "b"), (None, "c d")]])
def test_row_cases(spark, rows):
    found, windows, padding = check(spark, rows, 64)
    assert padding == 0 and (bool(rows) == bool(found))


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "cat", "z", 4, 5, True)], "doc_id long, text string, ids string, start int, part int, open boolean")
    assert packing.pack(docs, PATH).count() == 1


def test_packer_keeps_its_space_and_fills_best():
    packer = packing.Packer(10, 2, 0)
    one = lambda n: [(1, 0, b"abcd" * n, n)]
    assert list(packer.put(1, one(6), 6)) == [] and list(packer.put(2, one(7), 7)) == []
    assert list(packer.put(3, one(3), 3)) == [(2, one(7) + one(3))]  # best fit, not first fit
    assert list(packer.put(4, one(5), 5)) == []
    (closed,) = packer.put(5, one(8), 8)  # fits nowhere: the fullest takes its head and is closed, the rest is placed
    assert closed[0] == 1 and sum(len(p[2]) for p in closed[1]) == 40
    assert len(packer.open) <= 2
