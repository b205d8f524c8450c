"""Whitening of embeddings: exact covariance by Spark, components by spectral divide and conquer with QDWH."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmark.llm.hard_negatives import matrix
from slipmark.sources.scratch import stored

_LONG = (1 << 63) - 1
#: Whole numbers that are multiplied as doubles give exact sums below this.
_EXACT = float(1 << 53)
_EPS = float(np.finfo(float).eps)
#: Rows that are handled at once in a task.
ROWS = 4096


# --- spectral divide and conquer of a small symmetric matrix (dims x dims, on the driver) ---


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix by dynamically weighted Halley steps (QDWH).

    Steps with a large weight go through a QR decomposition, which no small singular value can spoil; later ones through
    Cholesky factors. A singular value of zero may end at any sign.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(float).tiny)
    low = max(_EPS, 1 / max(np.linalg.norm(_inverse(x), 1), 1) / np.sqrt(n))
    eye = np.eye(n)
    for _ in range(60):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square)) if low < 1 else 0.0
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            x = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            z = np.linalg.cholesky(eye + wc * x.T @ x)
            x = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if np.linalg.norm(x - before) <= np.cbrt(_EPS) * 1e-2 and 1 - low < 10 * _EPS:
            break
    return x


def _inverse(x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(x)
    except np.linalg.LinAlgError:
        return np.full_like(x, 1 / _EPS)


def _bases(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthogonal matrix whose first ``rank`` columns span the projector's range: QR with column pivoting, refined once."""
    n = len(projector)
    work, picked = projector.copy(), []
    for _ in range(rank):
        sizes = np.einsum("ij,ij->j", work, work)
        sizes[picked] = -1
        j = int(np.argmax(sizes))
        picked.append(j)
        q = work[:, j] / np.linalg.norm(work[:, j])
        work = work - np.outer(q, q @ work)
    inside, _ = np.linalg.qr(projector @ np.linalg.qr(projector[:, picked])[0])
    return np.linalg.qr(np.hstack([inside, np.eye(n)]))[0]


def _pair(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of two by one rotation."""
    if a[0, 1] == 0:
        return np.diag(a).copy(), np.eye(2)
    half = (a[1, 1] - a[0, 0]) / (2 * a[0, 1])
    t = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(1.0, half))
    c = 1 / np.hypot(1.0, t)
    s = t * c
    return np.array([a[0, 0] - t * a[0, 1], a[1, 1] + t * a[0, 1]]), np.array([[c, s], [-s, c]])


def divide(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors: the polar factor of ``a - shift`` gives the projector on the eigenvalues above the
    shift; its range and the rest are invariant, and are divided again. Off-diagonal parts below rounding end the division."""
    n = len(a)
    off = a - np.diag(np.diag(a))
    if n == 1 or np.abs(off).max() <= 0.5 * _EPS * scale / n:
        return np.diag(a).copy(), np.eye(n)
    if n == 2:
        return _pair(a)
    diagonal = np.sort(np.diag(a))
    middle = [(x + y) / 2 for x, y in zip(diagonal[:-1], diagonal[1:], strict=True)]
    around = sorted(middle, key=lambda x: abs(x - np.median(diagonal)))
    for shift in [*around[:3], np.trace(a) / n, *around[3:]]:
        polar = polar_factor(a - shift * np.eye(n))
        projector = (polar + np.eye(n)) / 2
        rank = int(np.rint(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = _bases(projector, rank)
        turned = basis.T @ a @ basis
        turned = (turned + turned.T) / 2
        if np.abs(turned[:rank, rank:]).max() > 100 * n * _EPS * scale:
            continue
        values, vectors = zip(divide(turned[:rank, :rank], scale), divide(turned[rank:, rank:], scale), strict=True)
        return np.concatenate(values), np.hstack([basis[:, :rank] @ vectors[0], basis[:, rank:] @ vectors[1]])
    return _rotations(a)


def _rotations(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What no shift parts (a cluster of equal eigenvalues, up to rounding), by rotations of two dimensions."""
    a, v = a.copy(), np.eye(len(a))
    for _ in range(30):
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                _, r = _pair(a[np.ix_([p, q], [p, q])])
                a[:, [p, q]] = a[:, [p, q]] @ r
                a[[p, q]] = r.T @ a[[p, q]]
                v[:, [p, q]] = v[:, [p, q]] @ r
        if np.abs(a - np.diag(np.diag(a))).max() <= _EPS * np.abs(a).max():
            break
    return np.diag(a).copy(), v


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix.

    After the division, corrections of first order remove what rounding left between the vectors, and Newton-Schulz steps
    make them orthogonal to the last place.
    """
    scale = float(np.linalg.norm(v, 2)) if v.size else 0.0
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    _, q = divide(v, scale)
    for _ in range(2):
        gram, turned = q.T @ q, q.T @ v @ q
        values = np.diag(turned) / np.diag(gram)
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > 1e3 * len(v) * _EPS * scale
        half = (np.eye(len(v)) - gram) / 2
        fix = np.where(apart, (turned - gram * values[None, :]) / np.where(apart, gaps, 1.0), half)
        q = q + q @ np.where(np.eye(len(v), dtype=bool), half, fix)
    for _ in range(2):
        q = q @ (1.5 * np.eye(len(v)) - 0.5 * (q.T @ q))
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order] / np.linalg.norm(q[:, order], axis=0)


# --- Spark: exact sums over the fit list, and the rows ---


def _exact_products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` of whole numbers, exact."""
    size = float(np.abs(x).max(initial=0))
    if size * size * max(1, len(x)) < _EXACT:
        return (x.astype(float).T @ x.astype(float)).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, matrix(part.column("x"))


def _moments(fit: DataFrame, near: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of dimensions, centred at the whole numbers ``near``, over the fit list.

    A task sends one row for each dimension: only its own sums, whatever the rows.
    """
    dims = len(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for _, x in _chunks(batches):
            total = total + _exact_products(x - near)
        for i in range(dims):
            sums = pa.array([str(s) for s in total[i, i:]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(sums), pa.int32()), pa.array(range(i, dims), pa.int32()), sums], ["i", "j", "s"])

    parts = fit.mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = np.zeros((dims, dims), object)
    for i, j, s in parts.collect():  # dims * (dims + 1) / 2 rows
        out[i, j] = out[j, i] = int(s)
    return out


def _ratio(a: int, b: int) -> float:
    return float(Fraction(int(a), int(b)))


class Whitening:
    """What is fitted: sizes of a few rows of ``dims`` numbers, so it is sent to each task as it is."""

    def __init__(self, n: int, sums: list[int], near: np.ndarray, moments: np.ndarray, most: int):
        self.n, self.near = n, near
        self.rest = np.array([s - n * int(m) for s, m in zip(sums, near, strict=True)], object)  # S - n * near, below n
        self.shift = np.array([_ratio(r, n) for r in self.rest])
        square = n * n
        covariance = np.array([[_ratio(n * moments[i, j] - self.rest[i] * self.rest[j], square) for j in range(len(near))] for i in range(len(near))])
        values, vectors = spectrum(covariance)
        self.trace = float(np.trace(covariance))
        self.rank = int((values > len(near) * 16 * _EPS * max(values.max(initial=0), 0)).sum()) if len(values) else 0
        count = min(most, self.rank)
        self.values, self.vectors = values[:count], vectors[:, :count]

    def project(self, x: np.ndarray) -> np.ndarray:
        """``(x - S/n)`` on each component over the root of its eigenvalue."""
        return ((x - self.near) - self.shift) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - S) ** 2``, exact; null where it is beyond a long."""
        moved = x - self.near
        bound = self.n * (float(np.abs(moved).max(initial=0)) + 1)
        if bound * bound * max(1, x.shape[1]) < _LONG:
            apart = self.n * moved - self.rest.astype(np.int64)
            return np.einsum("ij,ij->i", apart, apart).tolist()
        apart = self.n * moved.astype(object) - self.rest
        return [int(s) if s <= _LONG else None for s in (apart * apart).sum(axis=1)]


def _identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured in a pass of its own."""
    count, n = len(fitted.values), fitted.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((count, count)), np.zeros(count)
        for _, x in _chunks(batches):
            z = fitted.project(x)
            total, sums = total + z.T @ z, sums + z.sum(axis=0)
        whole = np.vstack([total, sums[None, :]])
        i, j = np.indices(whole.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), t) for a, t in ((i, pa.int32()), (j, pa.int32()), (whole, pa.float64()))], ["i", "j", "s"])

    parts = fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    whole = np.zeros((count + 1, count))
    for i, j, s in parts.collect():  # (count + 1) * count rows
        whole[i, j] = s
    means = whole[count] / n
    return float(np.abs(whole[:count] / n - np.outer(means, means) - np.eye(count)).max(initial=0))


def whiten(rows: DataFrame, scale: int = 64, offset: int = 1_000_000, most: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    ``rows`` has ``vec_id`` and ``embedding``. A component ``c`` becomes the whole number ``x = floor(scale * c) + offset``.
    The fit list is each different vector once: ``n`` of them, with sums ``S``. The covariance is exact up to its last
    rounding: products are summed as whole numbers, centred at the whole numbers nearest to the means, and what that leaves
    (less than one half) is taken off exactly. Its eigenvectors come from QDWH divide and conquer on the driver (a matrix of
    ``dims`` squared, whatever the rows); they are numbered from 1 by falling eigenvalue, and ``most`` of them are used.

    Equal vectors meet by partial aggregates, so a vector that a third of the rows hold is no hot group. The fit list is
    written once and read by three passes, each of which sends only ``dims`` squared sums from a task.

    Rows with a null vector, or a null or non-finite entry, are left out; null ids and repeated rows stay. Vectors of
    another length than the most frequent one of the fit list (of ties: the longest) are left out, also empty ones.
    Components without variance (up to rounding) have no whitened value and are not returned, so a single different vector
    gives no rows, like an empty table. ``deviation`` is null beyond a long. Entries beyond 2**62 / ``scale`` count as that.
    Equal eigenvalues (ties) have any orthonormal vectors of their space. Other columns, whatever their names, are not read.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    end = float(1 << 62)
    whole = F.transform(
        "embedding", lambda c: F.floor(F.greatest(F.least(F.lit(scale) * c.cast("double"), F.lit(end)), F.lit(-end))) + F.lit(offset)
    )
    used = rows.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    fit = stored(used.select("x").where(F.size("x") > 0).distinct(), "fit-list")
    sizes = fit.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims, n = sizes
    fit = fit.where(F.size("x") == dims)
    totals = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    found = {r.i: int(r.s) for r in totals.collect()}  # dims rows
    sums = [found[i] for i in range(dims)]
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    fitted = Whitening(n, sums, near, _moments(fit, near), most)
    if not fitted.rank:
        return rows.sparkSession.createDataFrame([], schema)
    error = _identity_error(fit, fitted)
    count = len(fitted.values)
    explained = fitted.values / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _chunks(batches):
            m = part.num_rows
            each = pa.array(np.repeat(np.arange(m), count))
            columns = [
                part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, n, np.int64)), pa.array(fitted.deviations(x), pa.int64()).take(each),
                pa.array(fitted.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return used.where(F.size("x") == dims).mapInArrow(run, schema)
