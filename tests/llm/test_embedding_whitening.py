"""Whitening against plain whole-number sums and another eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from slipmark.llm.embedding_whitening import polar_factor, spectrum, whiten

SCHEMA = "vec_id long, embedding array<double>"


def turned(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    v = (q * np.array(values, float)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    [3.0], [2.0, 1.0], list(range(64)), [1.0] * 20 + [2.0] * 20, [1.0] * 39 + [5.0], list(10.0 ** -np.arange(30)),
    [1 + 1e-13 * i for i in range(40)], [0.0] * 20 + list(range(1, 21)), [1e6] + [1.0] * 39, [5.0, 5.0, 5.0, 1.0] + [1e-9] * 36, [0.0] * 5,
])
def test_spectrum(values):
    v = turned(values)
    found, q = spectrum(v)
    size = max(values) or 1
    assert np.allclose(found, sorted(values, reverse=True), rtol=0, atol=1e-13 * size)
    assert np.abs(q.T @ q - np.eye(len(v))).max() < 1e-13 and np.abs(v @ q - q * found).max() < 1e-14 * size * len(v)


@pytest.mark.parametrize("n", [1, 5, 50])
def test_polar_factor_is_the_sign(n):
    a = turned(np.linspace(-2, 1.3, n), 4) if n > 1 else np.array([[-3.0]])
    w, u = np.linalg.eigh(a)
    assert np.abs(polar_factor(a) - (u * np.sign(w)) @ u.T).max() < 1e-13


def plain(rows, scale=64, offset=1_000_000):
    used = [(i, [math.floor(scale * c) + offset for c in x]) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    fit = sorted({tuple(x) for _, x in used})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    apart = [[n * x[d] - sums[d] for d in range(dims)] for x in fit]
    v = np.array([[float(Fraction(sum(a[i] * a[j] for a in apart), n**3)) for j in range(dims)] for i in range(dims)])
    return used, fit, n, sums, v


def check(spark, rows, components):
    used, fit, n, sums, v = plain(rows)
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(used) * components
    w, u = np.linalg.eigh(v)
    w, u = w[::-1], u[:, ::-1]
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, []).append(r)
    signs = {}
    for i, x in used:
        mine = by_row[i]
        assert {r.component for r in mine} == set(range(1, components + 1))
        for r in mine:
            k = r.component - 1
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r.explained == pytest.approx(w[k] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
            want = float(sum(float(Fraction(n * a - s, n)) * c for a, s, c in zip(x, sums, u[:, k])) / math.sqrt(w[k]))
            if abs(want) > 1e-6:
                sign = signs.setdefault(k, math.copysign(1, want * r.whitened))
                assert r.whitened * sign == pytest.approx(want, rel=1e-7, abs=1e-9)
    return got


@pytest.mark.parametrize("dims, components", [(1, 1), (5, 5), (24, 16)])
def test_equal_to_plain(spark, dims, components):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(300, dims)) * np.linspace(1, 3, dims)
    check(spark, [(i, [float(c) for c in r]) for i, r in enumerate(x)], components)


def test_copies_count_once_and_bad_rows_are_left_out(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(rng.normal(size=(80, 4)))]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(5000, [c + 1e-9 if abs(64 * c % 1 - 0.5) < 0.4 else c for c in rows[5][1]])]
    nan, inf = float("nan"), float("inf")
    rows += [(-1, None), (-2, [1.0, None, 0.0, 0.0]), (-3, [nan, 0.0, 0.0, 0.0]), (-4, [inf, 0.0, 0.0, 0.0]), (-5, [-inf] * 4)]
    check(spark, rows, 4)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r * [1e6, 1.0, 1e3] + [3e9, 0.0, -7e5]]) for i, r in enumerate(rng.normal(size=(60, 3)))]
    used, fit, n, sums, v = plain(rows)
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    w = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-4
    for r in got:
        x = dict(used)[r.vec_id]
        exact = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)
        if r.component == 1:
            assert r.explained == pytest.approx(w[0] / w.sum(), rel=1e-9)


def test_row_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whiten(frame(rows))
        assert got.collect() == [] and got.columns[:3] == ["vec_id", "component", "n"]
    rows = [(None, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [4.0, 1.0]), (4, [1.0]), (5, [])]
    got = whiten(frame(rows)).collect()  # the second dimension has no variance; other lengths are left out
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (2, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert all(r.explained == 1 and r.identity_error < 1e-12 for r in got)
    clash = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", x int, n int, component int")
    assert len(whiten(clash).collect()) == 4
