"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations of it."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.vectors import lists, of_length, scaled

#: Factor before rounding down, number added to it, components returned.
FACTOR, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows multiplied at a time, and the size of residuals up to which doubles hold their products' sums exactly.
ROWS, EXACT = 4096, 1 << 20
#: Rotations smaller than this are not made; sweeps end when none is.
SMALL, SWEEPS = 1e-15, 60


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pivots and lower triangular factor (d x rank) with v[order][:, order] = factor @ factor.T.

    The largest remaining diagonal is the next pivot; it ends where all that remain are rounding
    errors of what they were at first.
    """
    d = len(v)
    left, order = v.astype(float).copy(), np.arange(d)
    factor = np.zeros((d, d))
    least = d * np.finfo(float).eps * np.diag(v)
    for k in range(d):
        rest = np.diag(left)[k:]
        rest = np.where(rest > least[order[k:]], rest, 0)
        p = k + int(np.argmax(rest))
        if not rest[p - k]:
            return order, factor[:, :k]
        for a in (left, factor):
            a[[k, p]] = a[[p, k]]
        left[:, [k, p]] = left[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return order, factor


def _pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which every two of ``n`` columns meet once."""
    seats = list(range(n + n % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], seats[: half - 1 : -1], strict=True) if max(a, b) < n]
        out.append(tuple(np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def rotated_columns(factor: np.ndarray) -> np.ndarray:
    """The factor times the rotation that makes its columns orthogonal.

    Two columns are turned by the angle at which their inner product vanishes; sweeps over all
    pairs go on until no pair needs it.
    """
    a = factor.copy()
    rounds = _pairs(a.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            act = np.abs(gamma) > SMALL * np.sqrt(alpha * beta)
            if not act.any():
                continue
            turned = True
            zeta = (beta - alpha)[act] / (2 * gamma[act])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            x, y = x[:, act], y[:, act]
            a[:, p[act]], a[:, q[act]] = c * x - s * y, s * x + c * y
        if not turned:
            break
    return a


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and unit eigenvectors as columns; as many as its rank."""
    order, factor = pivoted_cholesky(v)
    turned = rotated_columns(factor)
    norms = np.sqrt((turned * turned).sum(0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(v), len(by)))
    vectors[order] = turned[:, by] / norms[by]
    return norms[by] ** 2, vectors


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, rows = np.unique(scaled(batch.column("vector"), FACTOR)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(rows.astype(np.int64))], names=["d", "n"])


def _sums(d: int):
    """A task's sums of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            _, x = of_length(batch.column("vector"), FACTOR, d, SHIFT)
            for at in range(0, len(x), 1024):
                total = [t + int(s) for t, s in zip(total, x[at : at + 1024].sum(axis=0), strict=True)]
        yield _numbers(total)

    return run


def _numbers(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(values), dtype=np.int32)), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["k", "v"]
    )


def _scatter(d: int, mean: np.ndarray):
    """A task's sums of products of two residuals (upper triangle), exact."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(upper[0])
        for batch in batches:
            u = of_length(batch.column("vector"), FACTOR, d, SHIFT)[1] - mean
            far = np.abs(u).max(axis=1, initial=0) > EXACT
            near = u[~far].astype(float)
            for at in range(0, len(near), ROWS):
                part = near[at : at + ROWS]
                total = [t + int(s) for t, s in zip(total, (part.T @ part)[upper], strict=True)]
            for row in u[far].tolist():
                total = [t + row[i] * row[j] for t, i, j in zip(total, *upper, strict=True)]
        yield _numbers(total)

    return run


class Whitening:
    """The fitted figures: rows, sums, mean as whole part and remainder, eigenvalues, components, trace."""

    def __init__(self, n: int, sums: list[int], products: list[int]):
        d = len(sums)
        self.n, self.d = n, d
        self.mean = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        # n^2 times the covariance is a whole number: residuals from the whole part, less what their mean adds
        v = np.zeros((d, d))
        for (i, j), p in zip(zip(*np.triu_indices(d), strict=True), products, strict=True):
            v[i, j] = v[j, i] = (n * p - self.rest[i] * self.rest[j]) / (n * n)
        self.trace = float(np.trace(v))
        self.values, self.vectors = principal(v)

    def keep(self, components: int) -> None:
        self.values, self.vectors = self.values[:components], self.vectors[:, :components]

    def residuals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, x = of_length(column, FACTOR, self.d, SHIFT)
        return rows, x - self.mean

    def whiten(self, u: np.ndarray) -> np.ndarray:
        rest = np.array([r / self.n for r in self.rest])
        return (u - rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, u: np.ndarray) -> list[int | None]:
        """Sum of squares of n * x - S; null beyond a long."""
        rest = np.array(self.rest, object)
        if self.d * (self.n * (int(np.abs(u).max(initial=0)) + 1)) ** 2 < 1 << 63:
            return ((self.n * u - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        out = ((self.n * u.astype(object) - rest) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in out]


def fit(rows: DataFrame) -> Whitening | None:
    """Fit on (vec_id, vector): three passes, of which d + d * (d + 1) / 2 exact sums reach the driver."""
    sizes = rows.mapInArrow(_lengths, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).filter("d > 0")
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most.d, most.n

    def added(task) -> list[int]:
        found = rows.mapInArrow(task, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
        return [int(r.v) for r in sorted(found, key=lambda r: r.k)]

    sums = added(_sums(d))
    return Whitening(n, sums, added(_scatter(d, np.array([s // n for s in sums], np.int64))))


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest difference between the covariance of the whitened rows and the unit matrix."""
    m = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            w = model.whiten(model.residuals(batch.column("vector"))[1])
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["k", "v"])

    found = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((m + 1, m))
    for r in found:
        total.reshape(-1)[r.k] = r.v / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(m)).max(initial=0))


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Embeddings on their principal components, each of unit variance.

    Entries become x = floor(64 * entry) + 1000000. Tasks add up exact whole sums: first x, then
    products of two residuals x - floor(mean), so the scatter is centred before multiplying and has no
    rounding, whatever the order of rows. Its pivoted Cholesky factor (d x d numbers, on the driver) is made
    orthogonal by one-sided Jacobi rotations: the squared norms of the columns are the eigenvalues, the
    normalised columns, in the order of the pivots undone, the components. One more pass measures the
    covariance of the whitened rows.

    Returns vec_id, component (from 1, by falling eigenvalue), n, deviation (sum of (n * x - S)^2; null
    beyond a long), whitened, explained (share of the trace), identity_error, for each row and
    component up to ``components``. Rows with a null vector or null or non-finite entries are left out; so
    are those of another length than the most frequent one (ties: the longer), for which no
    covariance is defined, and empty vectors. Components of no variance cannot be whitened and are left out: with
    one vector, or equal ones, or an empty table, the result is empty. Repeated rows count each; a null vec_id is
    kept. Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    model = fit(rows)
    schema = "vec_id long, deviation long, w array<double>"
    if model is None:
        values, error, n = np.zeros(0), 0.0, 0
        lists_of = rows.limit(0).selectExpr("vec_id", "0L AS deviation", "array(0D) AS w")
    else:
        model.keep(components)
        values, n = model.values, model.n
        error = _identity_error(rows, model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, u = model.residuals(batch.column("vector"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(model.deviation(u), pa.int64()), lists(model.whiten(u))],
                    names=["vec_id", "deviation", "w"],
                )

        lists_of = rows.mapInArrow(run, schema)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in values]) if len(values) else F.array(F.lit(0.0))
    return lists_of.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
