import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slipmark.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library(spark, library):
    draw = random.Random(3)
    parts = ["a", "B", "é", "日本", "1", "²", "'", "'s", "'ll", "'re", " ", "  ", "\n", " ", "　", "!", "…", "\x00", "\x1c", "😀",
             "<|endoftext|>", "word", " the", "'d", "'x", "\t", "'m's", "r", "e", "\u0085", "\x7f"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(0, 80))) for _ in range(3000)]
    texts += ["", None, " ", "'", "'s", "x" * 5000, " " * 3000, "ab " * 40000, "''s", "a 's", "a's's", "\n's", "  's", "\x00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 1024), repr(text)


def test_empty_table_null_ids_repeats(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(None, "a b", 1), (2, None, 2), (2, None, 3)], "doc_id long, text string, n_tokens long")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(df, PATH).collect()) == [(0, 2), (2, 0), (2, 0)]


def test_given_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(df, PATH).collect()} == want
