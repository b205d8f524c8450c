import random

import pytest
from llm.brute import jaccard_components as plain

from slipmark.llm.ngram_jaccard import jaccard_components


def result(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, **more).collect()}


@pytest.fixture(scope="module")
def rows():
    """Families of near copies with more and more changes, common passages, exact copies, short and empty texts."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    common = [word() for _ in range(40)]
    out = []
    for _ in range(4):
        base = [word() for _ in range(120)]
        for j in range(25):
            text = list(base)
            for _ in range(j // 3):
                text[draw.randrange(len(text))] = word()
            out.append(" ".join(text))
    out += [" ".join([*common, *(word() for _ in range(draw.randrange(1, 60)))]) for _ in range(60)]
    out += ["", None, "one", "One", "one two", "a b c d e", "A B\tC\nd e", " \x0b ", "a b c d f", "é È", "é è"] * 2
    return list(enumerate(out))


@pytest.mark.parametrize("min_docs", [2, 8, 1000])
def test_equals_all_pairs(spark, rows, min_docs):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, min_docs=min_docs) == plain(rows)


def test_small_capacity_changes_nothing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert result(df, min_docs=2, capacity=7) == plain(rows)


def test_empty_nulls_repeats_and_other_columns(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == {}
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text, 0, None), (1, text, 1, None), (None, text, 2, "x"), (3, None, 3, None)],
                               "doc_id long, text string, k int, tok string")
    rows = jaccard_components(df).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [
        (0, 4, 0), (1, 4, 1), (1, 4, 1), (3, 0, 3)]


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(df) == plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def stored_rows(monkeypatch, spark, texts, **more):
    """Rows of each table that the join stores, and its result."""
    from slipmark.llm import ngram_jaccard as module

    found, write = {}, module.stored

    def counted(df, name):
        out = write(df, name)
        found[name] = out.count()
        return out

    monkeypatch.setattr(module, "stored", counted)
    got = result(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **more)
    monkeypatch.setattr(module, "stored", write)
    return found, got


def test_texts_of_stock_paragraphs_store_few_pairs(spark, monkeypatch):
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    stock = [" ".join(word() for _ in range(40)) for _ in range(24)]
    texts = [" ".join(draw.sample(stock, 6)) for _ in range(600)]
    found, got = stored_rows(monkeypatch, spark, texts)
    assert got == plain(list(enumerate(texts)))
    assert found["jaccard-rest"] < len(texts) and found["jaccard-pairs"] < 20 * len(texts)


def test_common_words_beyond_the_frequent_set_store_few_pairs(spark, monkeypatch):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    common = " ".join(word() for _ in range(64))
    texts = [common + " " + " ".join(word() for _ in range(120)) for _ in range(300)]
    found, got = stored_rows(monkeypatch, spark, texts, capacity=4)
    assert got == plain(list(enumerate(texts)))
    assert found["jaccard-rest"] < len(texts) and found["jaccard-pairs"] < 20 * len(texts)


@pytest.mark.parametrize("light", [1, 3])
def test_any_bound_of_light_tokens_gives_the_same(spark, rows, light):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, min_docs=1000, light=light) == plain(rows)
