"""Whitening of vectors by their leading covariance eigenvectors: Chebyshev-filtered subspace iteration.

A pass multiplies a block Q of vectors by the covariance, V Q = sum of c (c . Q) / n over the centred rows c, on the executors:
no d x d matrix is made. A three-term recurrence of such passes applies a Chebyshev polynomial of V that stays small on
the unwanted part of the spectrum, from 0 to the block's least Ritz value, and grows fast beyond it. QR makes the filtered block orthonormal, Rayleigh-Ritz turns it to eigenvectors of V
within it, and V Q - Q e, which costs no further pass, certifies them: an eigenvalue is off by no more than that norm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcal.llm.common import forget, saved

#: Whole-number form of an entry c: floor(SCALE c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this have no exact whole-number form; their rows take no part.
LARGEST = 2.0**42
#: Passes of one filter, and how many filters at most.
DEGREE, ROUNDS = 12, 60
#: Residuals, as shares of the largest eigenvalue: certified below the first at once; below the second once they no longer shrink.
ENOUGH, CERTIFIED = 1e-14, 1e-11
#: Eigenvalues below this share of the largest count as 0.
RANK = 1e-11
SEED = 5


@dataclass(frozen=True)
class Whitening:
    """Fitted mean and components. The mean is ``base`` + ``rest`` / n, per dimension."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean, each entry rounded once."""
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2 per row, exact; null where it does not fit a long."""
        far = float(np.abs(x - self.base).max(initial=0)) + 1
        if (far * self.n) ** 2 * x.shape[1] < 2.0**62:
            return ((self.n * (x - self.base) - self.rest) ** 2).sum(axis=1).tolist()
        sums = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.rest.tolist(), strict=True)) for row in (x - self.base).tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def whole_vectors(rows: DataFrame, vector_col: str, keep: list[Column]) -> tuple[DataFrame, int]:
    """The rows with ``x``, their vectors in whole numbers, and the number of dimensions.

    Vectors that are null or empty, of another length than the commonest (the shorter, if two are), or hold null, non-finite
    or entries of 2^42 and more are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    fit = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    good = rows.select(*keep, v.alias("v")).where("v is not null and size(v) > 0").where(F.forall("v", fit))
    table = saved(good.select("*", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x")).drop("v"), "whole-vectors")
    size = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return table.where(F.size("x") == (size.d if size else 0)), size.d if size else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of whole numbers."""
    return column.flatten().to_numpy().reshape(-1, d)


def totals(points: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum of ``part(rows)`` over all batches of rows; each task sends one number per entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = None
        for batch in batches:
            if batch.num_rows:
                made = part(matrix(batch.column(0), d)).ravel()
                held = made if held is None else held + made
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(held)], names=["at", "value"])

    summed = points.select("x").mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r.value for r in sorted(summed, key=lambda r: r["at"])])


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of a positive semi-definite operator, falling, their unit vectors, and the largest residual.

    ``product`` multiplies a (d x block) matrix by it. Fails if the residuals stay above ``CERTIFIED``.
    """
    block = min(d, 4 * k)
    k = min(k, d)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, block)))[0]
    before = np.inf
    for _ in range(ROUNDS):
        image = product(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(values[0], np.finfo(float).tiny)
        residual = float(np.linalg.norm(image[:, :k] - q[:, :k] * values[:k], axis=0).max() / top)
        if residual <= ENOUGH or (residual <= CERTIFIED and residual > before / 2) or values[0] <= 0:
            return np.maximum(values[:k], 0), q[:, :k], residual
        before = residual
        # Chebyshev polynomial of the unwanted interval [0, least Ritz value], scaled to 1 at the largest.
        half = max(values[-1], 1e-3 * top) / 2
        scale = first = half / (top - half) if top > half else 1.0
        old, new = q, (image - half * q) * (scale / half)
        for _ in range(DEGREE - 1):
            then = 1 / (2 / first - scale)
            old, new = new, (product(new) - half * new) * (2 * then / half) - old * (scale * then)
            scale = then
        q = np.linalg.qr(new)[0]
    raise ArithmeticError(f"eigenvectors not certified: residual {before:.2g} of the largest eigenvalue")


def fit(points: DataFrame, d: int, k: int) -> Whitening:
    """Mean and the k leading components of the whole-number vectors ``x`` of ``points``, all of them.

    Components of eigenvalue 0 (constant dimensions, fewer vectors than components) are left out; no
    vectors give none.
    """
    both = totals(points, d, lambda x: np.append(x.sum(axis=0), len(x)), "bigint") if d else np.zeros(1, np.int64)
    n = int(both[-1]) if len(both) else 0
    if not n:
        return Whitening(0, np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    base = both[:-1] // n
    model = Whitening(n, base, both[:-1] - base * n, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    trace = float(totals(points, d, lambda x: np.square(model.centred(x)).sum(keepdims=True))[0]) / n

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            return c.T @ (c @ q)

        return totals(points, d, part).reshape(q.shape) / n

    values, vectors, residual = leading(product, d, k)
    some = values > RANK * values[0]
    return Whitening(n, model.base, model.rest, values[some], vectors[:, some], trace, residual)


def identity_error(points: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = totals(points, d, lambda x: model.whitened(x).sum(axis=0)) / model.n

    def part(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x) - mean
        return w.T @ w

    return float(np.abs(totals(points, d, part).reshape(k, k) / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and component up to k.

    Rows that ``whole_vectors`` leaves out take no part and get no rows; null ids and rows that repeat are kept as they
    are. There are no rows for components of eigenvalue 0, so none where all vectors are equal, and none for an
    empty table. Columns other than the two named are not read.
    """
    points, d = whole_vectors(rows, vector_col, [F.col(id_col).alias("id")])
    model = fit(points, d, k)
    error = identity_error(points, d, model)
    share = model.values / model.trace if model.trace else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = len(model.values)
        for batch in batches:
            if not batch.num_rows or not kinds:
                continue
            x = matrix(batch.column(1), d)
            each = np.repeat(np.arange(len(x)), kinds)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, kinds + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n, np.int64)),
                pa.array([s for s in model.deviations(x) for _ in range(kinds)], pa.int64()),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = points.schema["id"].dataType.simpleString()
    made = points.select("id", "x").mapInArrow(run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return made.withColumnRenamed("id", id_col)
