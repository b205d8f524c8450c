"""Row-local operators against plain versions."""

import random

import pytest
from llm.brute import LICENSE_WORD, licenses, lower, quality

from slipmark.llm.licenses import TEMPLATES, scan_licenses
from slipmark.llm.quality_rules import RULES, ablations, ledger
from slipmark.llm.quality_rules import quality as rules

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    parts = ["a", "b", "c", "é", "日本", "# ", "| ", "\n", "\n", " ", " ", "\t", "\x0b", "  ", "word ", "the ", "<x>", " ", "\x1c", "x" * 40]
    out = ["".join(draw.choices(parts, k=draw.randrange(0, 200))) for _ in range(300)]
    return out + ["", None, " \n ", "a b c a b c", "a a a a", "a b a b a b a", "one\none\n\none", "word " * 3000]


def test_quality_equals_plain(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in rules(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == quality(texts[r.doc_id]), repr(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_given_documents_of_good_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_ablations(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ledger", rules_column())
    rows = ledger(df)
    bits = [r.ledger.bits for r in rows.collect()]
    for r in ablations(rows, "v2").collect():
        bit = 1 << RULES.index(r.rule)
        assert (r.failed, r.only) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))
    assert [(r.failed, r.only) for r in ablations(rows.limit(0), "v1").collect()] == [(0, 0), (0, 0)]


def rules_column():
    from pyspark.sql import functions as F

    return F.lit("a column of the same name")


def test_native(spark):
    for df in (rules(spark.read.parquet(DOCUMENTS)), scan_licenses(spark.read.parquet(DOCUMENTS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_licenses_equal_plain(spark):
    texts = [
        "", None, "MIT", "Released under the MIT License.", "under the mit-license under the MIT license", "CC BY-NC 4.0 cc by nc",
        "Apache License, Version 2.0", "apache license version 20", "undér the mit license", "Under\x00The\x7fMit{License",
        "x " * 5000 + "under the mit license", "This work is licensed under the GNU General Public License, version 3",
        "mit Kapache", "Permission is hereby granted, free of charge, to any person obtaining a copy", "ccby nc cc by-sa 4.0",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licenses(text), repr(text)
    assert got[11].labels == "gpl-3" and got[13].labels == "mit" and 0 < got[11].score <= 1
    assert got[1].labels == "" and got[1].score == 0.0


def plain_labels(text, templates):
    """Every place of every key phrase, with the share of the template's words around it."""
    words = LICENSE_WORD.findall(lower(text))
    labels, best = set(licenses(text)[4].split(",")) - {""}, 1.0 if licenses(text)[1] else 0.0
    for label, whole, key in templates:
        of, key = whole.split(), key.split()
        first = next(i for i in range(len(of)) if of[i : i + len(key)] == key)
        for i in range(len(words)):
            if words[i : i + len(key)] == key:
                labels.add(label)
                held = sum(0 <= i - first + j < len(words) and words[i - first + j] == w for j, w in enumerate(of))
                best = max(best, held / len(of))
    return ",".join(sorted(labels)), best


def test_files_of_several_licenses_equal_a_plain_matcher(spark):
    draw = random.Random(3)
    wholes = [text for _, text, _ in TEMPLATES]
    filler = "the of and software is without any copy free use public version 2 0 under license terms".split()
    texts = ["", None, wholes[1], f"{wholes[1]} {wholes[3]}", f"{wholes[5]} and {wholes[3]}", f"{wholes[7]} {wholes[3]} {wholes[1]}"]
    for _ in range(120):
        parts = []
        for whole in draw.sample(wholes, draw.randrange(0, 5)):
            words = whole.split()
            for _ in range(draw.choice([0, 0, 1, 3])):
                words[draw.randrange(len(words))] = draw.choice(filler)
            cut = draw.choice([0, 0, 3])
            parts += words[cut:] + draw.choices(filler, k=draw.randrange(0, 30))
        texts.append(draw.choice([" ", ", ", "-"]).join(w.upper() if draw.random() < 0.1 else w for w in parts))
    texts += texts[3:6] + [texts[4] + " word" * 20_000]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, s int, score int")
    several = 0
    for r in scan_licenses(df).collect():
        labels, score = plain_labels(texts[r.doc_id], TEMPLATES)
        assert r.labels == labels and abs(r.score - score) < 1e-12, texts[r.doc_id]
        several += labels.count(",") > 0
    assert several > 40


def test_licenses_keep_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "under the mit license"), (1, "cc by nc 4.0"), (1, "cc by nc 4.0")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.labels) for r in scan_licenses(df).collect()) == [(0, "mit"), (1, "cc-by-nc"), (1, "cc-by-nc")]


def test_licenses_on_given_documents(spark):
    docs = spark.read.parquet(DOCUMENTS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licenses(texts[r.doc_id])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rules(none).count() == 0 and scan_licenses(none).count() == 0
