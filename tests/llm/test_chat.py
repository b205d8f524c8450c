import hashlib
import random

import public_tokenizers
import pytest

from slipmark.llm.chat import digest, escape, format_conversations, parse, render, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string"
HARD = ["", None, "a", "\\### Assistant: </turn> ok", "<turn>user<text>x</turn>", "\\l<\\\\l", "\n\n x \n", "é日本😀", "<|endoftext|>", " ", "\\", "a\x00b", "x" * 3000]


@pytest.mark.parametrize("text", [t for t in HARD if t is not None])
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and "<" not in escape(text)
    assert parse(render([(text, text), ("b", text)], frozenset())[0]) == [(text, text), ("b", text)]


def check(rows, df):
    talks = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        talks.setdefault(conv, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in digest(format_conversations(df, PATH)).collect()}
    assert got.keys() == talks.keys()
    for conv, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)), turns
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_hard_texts(spark):
    draw = random.Random(8)
    rows = [(draw.randrange(40), i, draw.choice(["user", "assistant", "system", "<turn>", None]), draw.choice(HARD), "x") for i in range(400)]
    rows += [(None, 1, "assistant", "a", "x"), (None, None, "assistant", "b", "x"), (77, 1, "assistant", "same", "x"), (77, 1, "assistant", "same", "x")]
    check(rows, spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_given_conversations_and_empty_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    check([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], df)
    assert digest(format_conversations(df.limit(0), PATH)).count() == 0
