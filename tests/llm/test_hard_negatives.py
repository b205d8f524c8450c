"""Hard negatives against every pair compared with plain numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipmark.llm import hard_negatives
from slipmark.llm.hard_negatives import mine

LONG = (1 << 63) - 1
SCHEMA = "vec_id long, embedding array<double>, label long"


def plain(rows, scale=256, every=50, positives=5, negatives=3, low=50, high=95):
    def whole(c):
        return max(-LONG - 1, min(LONG, math.floor(scale * c)))

    used = [
        (i, [whole(c) for c in x], label) for i, x, label in rows
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)
    ]
    out = []
    for a, (anchor, x, label) in enumerate(used):
        if anchor % every:
            continue
        scored = [
            (-max(-LONG, min(LONG, sum(p * q for p, q in zip(x, y)))), i, other == label)
            for b, (i, y, other) in enumerate(used) if a != b
        ]
        for score, positive, _ in sorted(s for s in scored if s[2])[:positives]:
            hard = sorted(s for s in scored if not s[2] and low * -score <= 100 * -s[0] <= high * -score)
            out += [(anchor, positive, n + 1, s[1], -score, -s[0]) for n, s in enumerate(hard[:negatives])]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mine(df, F.col("vec_id") % how.pop("every", 50) == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    label = rng.integers(0, labels, n)
    x = 0.6 * centres[label] + rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(c) for c in x[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 7, 40])
def test_equal_to_every_pair(spark, monkeypatch, dims):
    rows = vectors(400, dims, dims)
    assert found(spark, rows, every=9) == plain(rows, every=9)
    monkeypatch.setattr(hard_negatives, "WAVE_BYTES", 8 * dims * 7)  # several waves
    assert found(spark, rows, every=9) == plain(rows, every=9)


def test_ties_and_copies(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([0.0, 0.5, 1.0]) for _ in range(3)], draw.randrange(3)) for i in range(300)]
    rows += [(100 + k, [1.0, 0.5, 0.5], 1) for k in range(0, 40)] + [(600 + k, [1.0, 1.0, 1.0], 2) for k in range(60)]
    rows += [rows[0], rows[50], rows[50]]
    assert found(spark, rows, every=10) == plain(rows, every=10)


def test_numbers_beyond_doubles(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-3e9, 3e9) for _ in range(4)], i % 3) for i in range(120)]
    rows += [(i, [draw.uniform(-2e6, 2e6) for _ in range(4)], i % 3) for i in range(120, 240)]
    expected = plain(rows, every=10)
    assert expected and found(spark, rows, every=10) == expected


def test_row_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(60, 3, 8, labels=2)
    odd = [
        (None, [1.0, 0.0, 0.0], 1), (50, None, 1), (100, [1.0, None, 0.0], 1), (150, [nan, 0.0, 0.0], 0), (200, [inf, 1.0, 1.0], 0),
        (250, [1.0, 1.0, 1.0], None), (300, [0.5, 0.5], 1), (350, [], 0), (400, [-inf, 0.0, 0.0], 1),
    ]
    assert found(spark, good + odd, every=10) == plain(good + odd, every=10)
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1)]) == [] and found(spark, [(50, [1.0], 1)]) == []
    clash = spark.createDataFrame([(*r, 1, 2, 3) for r in good], SCHEMA + ", row int, x int, anchor int")
    assert sorted(tuple(r) for r in mine(clash, F.col("vec_id") % 10 == 0).collect()) == plain(good, every=10)


def test_scan_is_pruned():
    rng = np.random.default_rng(1)
    columns = rng.integers(-50, 50, (32, 2000)).astype(float)
    columns[:, 5] = 200.0
    anchor = np.concatenate([np.full(4, 300.0), rng.integers(-3, 3, 28).astype(float)])
    seen = []

    def keep(least, most):
        seen.append(len(least))
        return most >= np.max(least)

    left, scores = hard_negatives.vertical_scan(columns, columns.min(axis=1), columns.max(axis=1), anchor, np.ones(2000, bool), keep)
    assert left.tolist() == [5] and scores[0] == anchor @ columns[:, 5] and seen == [2000, 1, 1, 1]
