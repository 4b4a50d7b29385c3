"""Whitening of embeddings: principal components by FEAST contour integration.

Spark makes the fit list (each distinct vector once), and sums its first and second moments exactly, as whole numbers.
These d * (d + 1) / 2 sums for vectors of d entries are all that reaches the driver; they don't grow with the rows. There
FEAST finds the components of the covariance V:

* inertia counts of V - s tell how many eigenvalues lie above s (V is made tridiagonal first, so the count is a Sturm
  sequence), and bisection gives intervals, from the largest eigenvalue down, that hold the wanted ones;
* the resolvent (z - V)^-1 of random vectors, summed over Gauss-Legendre nodes z of a circle around an interval,
  projects them onto its eigenvectors; Rayleigh-Ritz extracts these, and both are repeated until the residuals vanish;
* the number of components in an interval must equal the inertia count, so none is missed.

A second pass over the fit list measures how far the covariance of the whitened vectors is from the identity, and a last
scan projects all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

SCALE = 256
COMPONENTS = 4
NODES = 16
ROUNDS = 40
#: Residuals of components, as a part of the trace: of the best round, and at most.
RESIDUAL = 1e-15
MOST_RESIDUAL = 1e-11
#: The ends of an interval are so many times apart at most.
SPAN = 4.0
#: Eigenvalues under this part of the trace are rounding; such components aren't returned.
LEAST_PART = 1e-10
#: Sums of whole numbers under this are exact in doubles.
EXACT = 1 << 53
LONG = 1 << 63

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, next diagonal) of a tridiagonal matrix with the eigenvalues of v, by Householder reflections."""
    a = np.array(v, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        # Two-sided reflection of the rest, and of its column.
        rest = a[k + 1 :, k + 1 :]
        y = rest @ x
        y -= (x @ y) * x
        rest -= 2 * (np.outer(x, y) + np.outer(y, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(bands: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """The inertia count: how many eigenvalues are larger than shift."""
    main, off = bands
    tiny = np.finfo(float).tiny
    count, q = 0, 1.0
    for k, d in enumerate(main):
        q = d - shift - (off[k - 1] ** 2 / q if k else 0.0)
        if q == 0:
            q = -tiny
        count += q > 0
    return count


def nearest(bands: tuple[np.ndarray, np.ndarray], low: float, high: float, rank: int, part: float) -> tuple[float, float]:
    """(below, above) the eigenvalue of this rank between low and high, a part of high apart."""
    while high - low > part * abs(high):
        mid = (low + high) / 2
        low, high = (mid, high) if above(bands, mid) >= rank else (low, mid)
    return low, high


def interval(bands: tuple[np.ndarray, np.ndarray], met: int, upto: float, k: int) -> tuple[float, float, int]:
    """(low, high, number): the next interval below upto, which has met eigenvalues above it.

    Its ends lie in gaps, at most a factor SPAN apart, so that no end is close to eigenvalues outside, in proportion to
    its width. It holds the k-th eigenvalue if that is within reach; more than that only if they are one cluster.
    """
    under, over = nearest(bands, 0.0, upto, met + 1, 1e-6)
    high = min(upto, over * 1.001)
    floor = under / SPAN
    last = min(k, above(bands, floor))
    low, _ = nearest(bands, floor, high, last, 1e-9)
    low -= 1e-8 * high  # below the whole cluster
    number = above(bands, low)
    gap = low / 2
    if above(bands, gap) > number:
        _, gap = nearest(bands, gap, low, number + 1, 1e-4)
    return (gap + low) / 2, high, number - met


def contour(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenvalues of a between low and high, falling, and their vectors."""
    n = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    # Nodes of the lower half are conjugate; the two halves together are twice the real part.
    turns = radius * np.exp(0.5j * np.pi * (x + 1))
    size = min(n, 2 * count + 8)
    y = np.random.default_rng(n).standard_normal((n, size))
    best = np.inf, np.zeros(0), np.zeros((n, 0))
    for _ in range(ROUNDS):
        projected = sum(weight / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(n) - a, y.astype(complex))).real for turn, weight in zip(turns, w, strict=True))
        base, _ = np.linalg.qr(projected)
        values, turned = np.linalg.eigh(base.T @ a @ base)
        y = base @ turned
        inside = np.flatnonzero((values > low) & (values <= high))[::-1]
        residual = np.linalg.norm(a @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0.0)
        if len(inside) == count:
            before = best[0]
            best = min(best, (residual, values[inside], y[:, inside]), key=lambda b: b[0])
            if residual < RESIDUAL or residual > before / 2:
                break
    if best[0] > MOST_RESIDUAL:
        raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but the contour gives others")
    return best[1:]


def feast(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest eigenvalues of a symmetric v, by falling eigenvalue.

    Those under LEAST_PART of the trace are left out. Of equal eigenvalues any orthonormal vectors come out.
    """
    n = len(v)
    trace = float(np.trace(v))
    if trace <= 0:
        return np.zeros(0), np.zeros((n, 0))
    a = v / trace
    bands = tridiagonal(a)
    k = min(k, above(bands, LEAST_PART))
    values, vectors, low = np.zeros(0), np.zeros((n, 0)), 1.001
    while len(values) < k:
        low, high, count = interval(bands, len(values), low, k)
        more, columns = contour(a, low, high, count)
        values, vectors = np.append(values, more), np.hstack([vectors, columns])
    return values[:k] * trace, vectors[:, :k]


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their sums, the trace of their covariance, and its largest eigenvalues with their vectors."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(x less the mean, squares of n * x - sums summed); sums of squares beyond a long are None."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most**2 * max(1, x.shape[1]) < LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return d / self.n, (d * d).sum(axis=1).tolist()
        exact = self.n * x.astype(object) - np.array(self.sums, object)
        squares = (exact * exact).sum(axis=1).tolist()
        return (exact / self.n).astype(float), [s if s < LONG else None for s in squares]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def whole(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector can be used: whole numbers, SCALE times as large as the entries."""
    scaled = F.transform(F.col(vector), lambda c: c.cast("double") * SCALE)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LONG)))
    return rows.where((F.size("v") > 0) & usable).select("vec_id", F.transform("v", lambda c: F.floor(c)).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def exact_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns, and of the products of columns in pairs, as whole Python numbers."""
    width = x.shape[1]
    first, second = np.zeros(width, object), np.zeros((width, width), object)
    most = int(np.abs(x.astype(float)).max(initial=0)) + 1
    rows = EXACT // most**2
    if rows == 0:
        big = x.astype(object)
        return big.sum(axis=0), big.T @ big
    for k in range(0, len(x), rows):
        part = x[k : k + rows].astype(float)
        first += part.sum(axis=0).astype(np.int64)
        second += (part.T @ part).astype(np.int64)
    return first, second


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of the vectors of fit; each task adds its own up first."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(width, object), np.zeros(len(upper[0]), object)
        for batch in batches:
            if batch.num_rows:
                one, two = exact_sums(matrix(batch.column(0)))
                n, first, second = n + batch.num_rows, first + one, second + two[upper]
        told = [n, *first.tolist(), *second.tolist()]
        yield pa.record_batch([pa.array(np.arange(len(told), dtype=np.int32)), pa.array([Decimal(int(v)) for v in told], pa.decimal128(38, 0))], ["k", "v"])

    rows = fit.select("x").mapInArrow(run, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
    told = [0] * (1 + width + len(upper[0]))
    for r in rows:
        told[r["k"]] = int(r["v"])
    second = [[0] * width for _ in range(width)]
    for i, j, v in zip(*upper, told[1 + width :], strict=True):
        second[i][j] = second[j][i] = v
    return told[0], told[1 : 1 + width], second


def fitted(fit: DataFrame, width: int, components: int) -> Whitening:
    """The whitening of the distinct vectors x of fit, all of the same width."""
    n, sums, products = moments(fit, width)
    # Whole numbers are divided once, so each entry is the nearest double.
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / n**2 for j in range(width)] for i in range(width)]) if n else np.zeros((width, width))
    trace = float(np.trace(v))
    return Whitening(n, sums, trace, *feast(v, components))


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of whitened fit vectors, less the identity; centred before multiplying."""
    k = len(w.values)

    def added(value, width: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    out += value(w.project(w.deviations(matrix(batch.column(0)))[0]))
            yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), pa.array(out)], ["k", "v"])

        rows = fit.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in rows:
            out[r["k"]] = r["v"]
        return out

    mean = added(lambda y: y.sum(axis=0), k) / w.n
    products = added(lambda y: ((y - mean).T @ (y - mean)).ravel(), k * k) / w.n
    return float(np.abs(products.reshape(k, k) - np.eye(k)).max())


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Up to `components` rows for each usable row: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds a null, a non-finite entry or one of 2**55 and more (256 times as much
    is no long), are dropped. Vectors must be of one length: that of most rows, or the longer of two; others are dropped
    too. Repeated vectors count once in the fit and get a row each; a null vec_id stays null. Components with no
    variance are not returned, so an empty table, or one vector alone, gives an empty result. A deviation that a long
    can't hold is null. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = whole(vectors, vec_id, vector)
    with Tables(spark) as tables:
        distinct = tables.put(rows.groupBy("x").agg(F.count("*").alias("copies")), "distinct-vectors")
        length = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        width = length["d"] if length else 0
        fit = distinct.where(F.size("x") == width)
        w = fitted(fit, width, components)
        error = identity_error(fit, w) if len(w.values) else 0.0
    k = len(w.values)
    explained = w.values / w.trace if k else w.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            centred, squares = w.deviations(matrix(batch.column(1)))
            n = batch.num_rows
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
            deviation = pa.array([s for s in squares for _ in range(k)], pa.int64())
            cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, w.n)), deviation, pa.array(w.project(centred).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))]
            yield pa.record_batch(cols, [c.split()[0] for c in RESULT.split(", ")])

    return rows.where(F.size("x") == width).mapInArrow(run, RESULT)
