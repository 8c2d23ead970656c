"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, written

EPS = float(np.finfo(np.float64).eps)
LONG = (1 << 63) - 1


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): scatter[order][:, order] = L L^T. L is lower triangular; columns end where the pivots that are left are rounding."""
    rest, order, columns = scatter.astype(np.float64), np.arange(len(scatter)), []
    least = len(scatter) * EPS * rest.diagonal().max(initial=0.0)
    for k in range(len(scatter)):
        p = k + int(rest.diagonal()[k:].argmax())
        if not rest[p, p] > least:
            break
        swap = [p, k]
        rest[[k, p]] = rest[swap]
        rest[:, [k, p]] = rest[:, swap]
        order[[k, p]] = order[swap]
        for c in columns:
            c[[k, p]] = c[swap]
        column = np.zeros(len(scatter))
        column[k:] = rest[k:, k] / np.sqrt(rest[k, k])
        rest[k:, k:] -= np.outer(column[k:], column[k:])
        columns.append(column)
    return np.array(columns).reshape(len(columns), len(scatter)).T, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal.

    A sweep meets every pair once, in rounds of disjoint pairs that are rotated together. The columns are then
    the eigenvectors of factor factor^T times the roots of their eigenvalues.
    """
    a = np.c_[factor, np.zeros((len(factor), factor.shape[1] % 2))]
    seats, half = np.arange(a.shape[1]), a.shape[1] // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(a.shape[1] - 1, 0)):
            i, j = seats[:half], seats[::-1][:half]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                off = np.where(xx * yy > 0, np.abs(xy) / np.sqrt(xx * yy), 0.0)
                turn = off > EPS
                zeta = np.where(turn, (yy - xx) / (2 * xy), 0.0)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, t * c, 0.0)
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            worst = max(worst, float(off.max(initial=0.0)))
            seats[1:] = np.roll(seats[1:], 1)
        if worst <= 8 * EPS:
            break
    return a  # a column added to make their number even stays zero


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of a symmetric matrix without negative eigenvalues; those that are rounding only are left out."""
    factor, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    values = (turned * turned).sum(0)
    rank = np.argsort(-values, kind="stable")
    rank = rank[values[rank] > len(scatter) * EPS * values.max(initial=0.0)]
    vectors = np.empty((len(scatter), len(rank)))
    vectors[order] = turned[:, rank] / np.sqrt(values[rank])
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(rank))]) if len(rank) else 1.0
    return values[rank], vectors * signs


@dataclass
class Whitening:
    """What a fit found: distinct vectors, their sums per dimension, eigenvalues of their covariance (falling), unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def mean(self) -> np.ndarray:
        """The mean of the fit list."""
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened coordinates of rows of x: centred, then projected, then over the root of the eigenvalue."""
        k = min(components, len(self.values))
        return (x - self.mean()) @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry as long (at the ends of long where it is beyond); null if the vector is null or has a null or non-finite entry."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~odd, F.transform(entries, lambda c: F.floor(c * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch of arrays of one length as a matrix of long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension: sums per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            safe = len(x) == 0 or np.abs(x.astype(np.float64)).max() * len(x) < LONG / 2
            sums = [a + int(b) for a, b in zip(sums, x.sum(0) if safe else x.astype(object).sum(0), strict=True)]
            rows += len(x)
        if rows:
            yield pa.RecordBatch.from_pylist([{"place": k, "rows": rows, "total": s} for k, s in enumerate(sums)], schema=pa.schema([("place", pa.int32()), ("rows", pa.int64()), ("total", pa.decimal128(38, 0))]))

    got = fit.select("x").mapInArrow(run, "place int, rows long, total decimal(38,0)").groupBy("place").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).collect()
    sums = {r.place: int(r.total) for r in got}
    return (got[0].rows if got else 0), [sums.get(k, 0) for k in range(width)]


def _moments(fit: DataFrame, width: int, made: int, coordinates) -> np.ndarray:
    """Sum over the fit list of the outer product of coordinates(x) (made columns): a triangle per task, added up by Spark; made * (made + 1) / 2 numbers come back."""
    low, high = np.tril_indices(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = coordinates(_matrix(batch.column(0), width))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(total[low, high])], names=["i", "j", "v"])

    out = np.zeros((made, made))
    for r in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fit_whitening(fit: DataFrame, width: int) -> Whitening:
    """Fit to the column x (arrays of long of one length) of a table: two passes, sums first, then the scatter of the centred vectors.

    Only sums, and the triangle of a width x width matrix, reach the driver; its size depends on the width alone.
    """
    n, sums = _summed(fit, width)
    if not n:
        return Whitening(0, sums, np.empty(0), np.empty((width, 0)))
    mean = np.array([s / n for s in sums])
    values, vectors = eigen(_moments(fit, width, width, lambda x: x - mean) / n)
    return Whitening(n, sums, values, vectors)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - sums)^2 for each row, exact; None where it is no long."""
    rough = n * x.astype(np.float64) - np.array(sums, np.float64)
    if (rough * rough).sum(1).max(initial=0.0) < LONG / 2 and np.abs(rough).max(initial=0.0) < 2**31 and n * np.abs(x.astype(np.float64)).max(initial=0.0) < LONG / 2:
        exact = n * x - np.array(sums, np.int64)
        return (exact * exact).sum(1).tolist()
    exact = n * x.astype(object) - np.array(sums, object)
    return [s if s <= LONG else None for s in (exact * exact).sum(1)]


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector on the first components of the distinct integer vectors.

    Entries become x = floor(scale * c). The fit list holds each distinct x once: its sums, then the scatter of
    its centred vectors, are added up by Spark; the width x width scatter is factored by pivoted Cholesky and
    the triangular factor turned by one-sided Jacobi. Every task then projects its own rows; a third pass over
    the fit list measures the covariance of the whitened coordinates.

    Returns id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error:
    a row per remaining row and component. Null vectors and vectors with null, NaN or infinite entries give
    none. The length is that of most distinct vectors (the longer of ties); vectors of another length give
    none, nor do empty ones. Components whose eigenvalue is rounding are left out: fewer than two distinct
    vectors, or an empty table, give an empty result. Repeated rows give repeated results, null ids stay;
    equal eigenvalues come in any order; a deviation beyond long is null; other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), integer_vector(F.col(vec_col), scale).alias("x")).where("size(x) > 0")
    fit = written(rows.select("x").distinct(), "fit")
    most = fit.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = most.width if most else 1
    fitted = fit_whitening(fit.where(F.size("x") == width), width)
    k = min(components, len(fitted.values))
    error = 0.0
    if k:
        sums = _moments(fit.where(F.size("x") == width), width, k + 1, lambda x: np.c_[np.ones(len(x)), fitted.project(x, k)])
        mean = sums[0, 1:] / fitted.n
        error = float(np.abs(sums[1:, 1:] / fitted.n - np.outer(mean, mean) - np.eye(k)).max())
    release(fit)
    explained = (fitted.values[:k] / fitted.values.sum()).tolist() if k else []
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(at), fitted.n)),
                    pa.array(deviations(x, fitted.n, fitted.sums), pa.int64()).take(pa.array(at)),
                    pa.array(fitted.project(x, k).ravel()),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array(np.full(len(at), error)),
                ],
                names=names,
            )

    same = rows.where(F.size("x") == width)
    return same.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
