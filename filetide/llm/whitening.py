"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi (operator 12).

Vectors become whole numbers (``floor(scale * entry)``); each distinct one counts
once in the fit. Two passes over the distinct vectors give their exact sums and
then the scatter of the centred vectors, both added up by Spark from one partial
result a task. The scatter, d x d for d dimensions, is the only thing the driver
holds. It is factored as ``L L'`` by Cholesky with diagonal pivots, which stops at
the numerical rank; one-sided Jacobi rotations make the columns of ``L``
orthogonal. Their squared norms are the eigenvalues of the scatter, and the
normalised columns its eigenvectors. A third pass measures how far the covariance
of the whitened vectors is from the identity.

Defined results: rows whose vector is null, holds null or non-finite entries, or
has another number of dimensions than most have (ties: the fewest) take no part;
rows with a null or a repeated ``vec_id`` stay, each with its own results;
components whose eigenvalue is zero to working precision have no whitened values
and are left out, so that a table of equal vectors, or an empty one, gives no
rows; a deviation beyond a long is null; every component's largest entry (the
first of equal ones) is positive. Columns of the input other than the vector and
its id are not read. Entries beyond 2^63 / ``scale`` count as that bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE = 256
COMPONENTS = 4
LONG = np.iinfo(np.int64)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """``(vec_id, x array<long>)`` of the rows that take part, and their dimension."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & finite)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x")), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column("x"), d)
            # Upper and lower halves, so that no sum of a batch leaves 64 bits.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            n += len(x)
            totals = [t + (h << 32) + w for t, h, w in zip(totals, high, low)]
        halves = [(t >> 62, t & ((1 << 62) - 1)) for t in totals]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(d)], pa.int32()), pa.array([0, *[h for h, _ in halves]], pa.int64()), pa.array([n, *[w for _, w in halves]], pa.int64())],
            names=["j", "high", "low"],
        )

    parts = rows.select("x").mapInArrow(partial, "j int, high long, low long").groupBy("j")
    exact = parts.agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]).collect()  # d + 1 rows
    found = {r["j"]: (int(r["high"]) << 62) + int(r["low"]) for r in exact}
    return found.get(-1, 0), [found.get(j, 0) for j in range(d)]


def added(rows: DataFrame, size: int, work) -> np.ndarray:
    """Sum over all rows of a matrix with ``size`` columns that ``work`` makes of every batch's vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            one = work(matrix(batch.column("x"), size))
            total = one if total is None else total + one
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    cells = rows.select("x").mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1))
    out[cells["i"], cells["j"]] = cells["value"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``L`` with ``L @ L.T == a``, one column for each pivot; lower triangular when rows follow the pivots."""
    d = len(a)
    factor, left, order = np.zeros((d, d)), a.diagonal().copy(), np.arange(d)
    floor = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        j = k + int(left[order[k:]].argmax())
        order[[k, j]] = order[[j, k]]
        p, rest = order[k], order[k + 1 :]
        if left[p] <= floor:
            return factor[:, :k]
        factor[p, k] = np.sqrt(left[p])
        factor[rest, k] = (a[rest, p] - factor[rest, :k] @ factor[p, :k]) / factor[p, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated among themselves until each pair is orthogonal to working precision.

    Pairs meet in rounds of a tournament, so that the rotations of a round touch
    different columns and are done together.
    """
    work = factor.copy()
    r = work.shape[1]
    seats = list(range(r + r % 2))
    for _ in range(sweeps if r > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(p, q) for p, q in zip(seats[:half], seats[: half - 1 : -1]) if p < r and q < r]
            p, q = (np.array(x) for x in zip(*pairs))
            a, b = work[:, p], work[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            cosine = np.abs(ab) / np.maximum(np.sqrt(aa * bb), np.finfo(float).tiny)
            worst = max(worst, float(cosine.max()))
            turn = cosine > np.finfo(float).eps
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            work[:, p], work[:, q] = c * a - s * b, s * a + c * b
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= 4 * np.finfo(float).eps:
            break
    return work


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with their ``sums``; components as columns, with eigenvalues of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - sum)^2``, exact."""
        n, s = self.n, self.sums
        largest = max(int(np.abs(x.astype(float)).max(initial=0)) + 1, max(map(abs, s), default=0))
        kind = np.int64 if largest * largest * len(s) < 1 << 62 else object
        x, s = x.astype(kind), np.array(s, kind)
        squares, products, own = (x * x).sum(axis=1).tolist(), (x * s).sum(axis=1).tolist(), sum(v * v for v in self.sums)
        exact = (n * n * a - 2 * n * b + own for a, b in zip(squares, products))
        return [e if e <= LONG.max else None for e in exact]


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the rows of ``distinct``, each counted once; none for an empty table."""
    n, sums = exact_sums(distinct, d) if d else (0, [])
    if not n:
        return None
    mean = np.array([s / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    whole = added(distinct, d, scatter)
    turned = jacobi_columns(pivoted_cholesky((whole + whole.T) / 2))
    energy = (turned * turned).sum(axis=0)
    order = np.argsort(-energy, kind="stable")[:components]
    order = order[energy[order] > d * np.finfo(float).eps * max(np.trace(whole), np.finfo(float).tiny)]
    axes = turned[:, order] / np.sqrt(energy[order])
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0) if len(order) else axes
    return Whitening(n, sums, axes, energy[order] / n, float(np.trace(whole)) / n)


def identity_error(distinct: DataFrame, d: int, model: Whitening) -> float:
    """Largest entry of the whitened covariance minus the identity, measured over the fitted rows."""
    k = len(model.eigenvalues)

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([model.apply(x), np.ones(len(x))])
        return w.T @ w

    total = added(distinct, d, moments) / model.n
    centre = total[:k, k]
    return float(np.abs(total[:k, :k] - np.outer(centre, centre) - np.eye(k)).max())


def whitened(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """One row for each row and component."""
    k = len(model.eigenvalues)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), d)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(at), model.n, np.int64)), pa.array(model.deviation(x), pa.int64()).take(at),
                    pa.array(model.apply(x).ravel()), pa.array(np.tile(model.eigenvalues / model.trace, len(x))),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(work, RESULT)


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row of ``vectors``."""
    spark = vectors.sparkSession
    rows, d = quantised(vectors, column, scale)
    # Equal vectors meet before the exchange already, so one repeated in a third of the rows is no hot key.
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, d, components)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], f"{RESULT}, identity_error double")
    error = identity_error(distinct, d, model)
    return whitened(rows, d, model).withColumn("identity_error", F.lit(error))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
