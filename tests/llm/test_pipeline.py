import random

import corpus_pipeline
from llm.brute import jaccard_components, quality
from llm.test_mixing import check

from slipmark.sources.scratch import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    passed = stages["quality rules"](spark, docs, FOLDER)
    assert passed.columns == docs.columns
    kept = {r.doc_id for r in passed.collect()}
    assert kept == {i for i, r in rows.items() if not (q := quality(r.text))[5] and 5 * q[2] <= q[0]}
    one = stages["n-gram Jaccard join"](spark, passed, FOLDER)
    assert one.columns == docs.columns
    groups = jaccard_components([(i, rows[i].text) for i in sorted(kept)])
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in groups.values()})
    clean = stages["secret scans"](spark, stages["benchmark decontamination"](spark, one, FOLDER), FOLDER)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(t == rows[i].text for i, t in texts.items() if "[SECRET]" not in t)
    check(stages["mixing sources to target weights"](spark, clean, FOLDER).collect(), texts.values())


def test_odd_rows(spark):
    draw = random.Random(9)
    text = " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(90))
    rows = [(1, text, "x", None), (1, text, "x", None), (2, text, "y", None), (3, None, None, 1), (None, text + " more words", "x", 2), (4, "", "x", 3)]
    rows.append((1, " ".join("".join(draw.choices("jklmnop", k=5)) for _ in range(90)), "z", 5))  # the same id, another text
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bits long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "source", "bits"]
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 1]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.count() == 0


def test_columns_with_the_names_used_inside(spark):
    draw = random.Random(10)
    text = lambda: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(90))
    names = ["ledger", "bad", "key", "whole", "row", "id", "hash", "label", "node", "tok", "n", "k", "skey", "spans", "a.b"]
    clash = ", ".join(f"`{n}` string" for n in names)
    rows = [(i, text(), "s", *[f"{n}{i}" for n in names]) for i in range(4)] + [(9, None, None, *[None] * len(names))]
    given = spark.createDataFrame(rows, f"doc_id long, text string, source string, {clash}")
    docs = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.schema.simpleString() == given.schema.simpleString()
    assert sorted(tuple(r) for r in docs.collect()) == rows[:4]
    assert {r.doc_id: r.size for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()} == dict.fromkeys(range(4), 90)
