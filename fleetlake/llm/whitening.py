"""Whitening of embeddings by shifted CholeskyQR.

Vectors are put on an integer grid, ``x = floor(scale * c) + offset``, so that equal vectors, sums and distances are exact. The fit
list holds each distinct ``x`` once (a shuffle by ``x``, summed before it, so a group of copies is one row of each task). Its
rows are centred exactly, ``(n x - S) / n``, and then orthogonalised again and again: a pass sums the Gram matrix of
``rows * R^-1`` over the tasks, the driver takes its Cholesky factor, with a shift by the rounding error of the sum, and
multiplies it into ``R``; the next pass reaches ``rows * R^-1`` by a triangular solve. The shift lets the first pass live
through any condition number, and the later passes remove what it and rounding left, so small components keep their
digits, which the eigenvalues of one Gram matrix would lose. When the rows are orthonormal (or zero, where the vectors
lie in a subspace), the singular value decomposition of ``R`` has the components and their variances.

Each task sums its own rows; a sum over tasks has d (d + 1) / 2 rows, which is all that the driver gets, as it gets d sums:
bounded by the dimension ``d``, whatever the number of vectors. The fit list is stored once and read by every pass.

Defined cases: a vector that is null, empty, holds a null or non-finite entry, or lies outside the grid of long integers
(an entry of 2**52 or more) is left out; so is one whose length is not the most frequent one (of equally frequent ones
the largest). A component without variance (its standard deviation below 1e-12 of the largest) has no rows, so a table
with one distinct vector gives none, as does an empty table. Repeated and null ids keep a row for each of their vectors.
A deviation that no long integer holds is null. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import bounded_batches, stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Components whose standard deviation is a smaller share of the largest have no variance.
LEAST_SHARE = 1e-12
#: The passes end when all eigenvalues of the Gram matrix are this near to one or zero.
ORTHONORMAL = 1e-11
MOST_PASSES = 8
_LARGEST = float(1 << 52)


def grid_vectors(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(vec_id, x)``: the vectors that take part, on the grid."""
    usable = F.forall("embedding", lambda e: F.coalesce(F.abs(e.cast("double") * scale) < _LARGEST, F.lit(False)))  # false for NaN, too
    grid = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale) + F.lit(offset).cast("long"))
    return bounded_batches(vectors).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & usable).select("vec_id", grid.alias("x"))


def _rows(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n`` with one rounding: the difference is taken in integers, of 64 bits if they hold it."""
    exact = x.astype(object) * n - sums if _is_wide(x, n, sums) else x * np.int64(n) - sums.astype(np.int64)
    return (exact / n).astype(float)


def _is_wide(x: np.ndarray, n: int, sums: np.ndarray) -> bool:
    return int(np.abs(x).max(initial=0)) * n + max(abs(int(s)) for s in sums) >= 1 << 62


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of squares of ``n x - sums``."""
    wide = _is_wide(x, n, sums)
    apart = x.astype(object) * n - sums if wide else x * np.int64(n) - sums.astype(np.int64)
    if wide or int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] >= 1 << 63:
        exact = (apart.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]
    return (apart * apart).sum(axis=1).tolist()


def _summed(fit: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The Gram matrix of ``rows_of(x)`` over all rows, summed in the tasks and then over them."""
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(_rows(batch))
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["at", "value"])

    found = fit.select("x").mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    gram = np.zeros((d, d))
    for r in found:
        gram[upper[0][r["at"]], upper[1][r["at"]]] = r["value"]
    return gram + np.triu(gram, 1).T


def _factor(gram: np.ndarray) -> np.ndarray:
    """The upper Cholesky factor, shifted by the rounding error of the sum, and by more while it does not exist."""
    d = len(gram)
    shift = d * np.finfo(float).eps * np.trace(gram)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` distinct vectors with ``sums``; ``directions`` (d x k) are the unit components by falling
    variance, ``variances`` theirs, ``total`` the variance of all."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.directions / np.sqrt(self.variances)


def distinct_vectors(grid: DataFrame) -> DataFrame:
    """The fit list: each distinct vector of the usual length once, stored."""
    usual = grid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return stored(grid.where(F.size("x") == (usual["d"] if usual else -1)).select("x").distinct(), "whitening-fit")


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the rows of ``fit_list (x)``; None if there are none."""
    dims = fit_list.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    found = sorted(dims.collect())
    if not found:
        return None
    n, d = found[0]["n"], len(found)
    sums = np.array([int(r["total"]) for r in found], dtype=object)
    factor = np.eye(d)
    for passes in range(1, MOST_PASSES + 1):
        now = factor
        gram = _summed(fit_list, lambda x: np.linalg.solve(now.T, _centred(x, n, sums).T).T, d)
        values, axes = np.linalg.eigh(gram)
        if passes == MOST_PASSES or not gram.any() or np.minimum(np.abs(values), np.abs(values - 1)).max() <= ORTHONORMAL:
            break
        factor = _factor(gram) @ factor
    # The last Gram matrix counts as well: it is zero where the vectors have no extent and the shifts made one up.
    _, deviations, directions = np.linalg.svd(np.sqrt(np.maximum(values, 0))[:, None] * axes.T @ factor)
    kept = deviations[:components] > LEAST_SHARE * deviations[0]
    kept &= deviations[:components] > 0
    variances = deviations ** 2 / n
    return Whitening(n, sums, directions[:components][kept].T, variances[:components][kept], float(variances.sum()))


def identity_error(fit_list: DataFrame, whitening: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, over all its rows."""
    k = len(whitening.variances)
    if not k:
        return 0.0

    def rows(x: np.ndarray) -> np.ndarray:
        return np.hstack([whitening.project(x), np.ones((len(x), 1))])

    moments = _summed(fit_list, rows, k + 1) / whitening.n
    means = moments[:k, k]
    return float(np.abs(moments[:k, :k] - np.outer(means, means) - np.eye(k)).max())


def whiten(grid: DataFrame, whitening: Whitening) -> DataFrame:
    """``(vec_id, deviation, whitened array<double>)`` of every row of ``grid`` that has the fitted length."""

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whitening.variances)
        for batch in batches:
            x = _rows(batch)
            if not len(x):
                continue
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(whitening.project(x).ravel()))
            deviation = pa.array(_deviations(x, whitening.n, whitening.sums), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, white], names=["vec_id", "deviation", "whitened"])

    usual = grid.where(F.size("x") == len(whitening.sums))
    return usual.mapInArrow(projected, "vec_id long, deviation long, whitened array<double>")


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: the fit, the vector's deviation and its whitened coordinate."""
    grid = grid_vectors(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fit_list = distinct_vectors(grid)
    whitening = fit(fit_list, components)
    if whitening is None:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fit_list, whitening)
    explained = F.array(*[F.lit(float(v / whitening.total)) for v in whitening.variances]) if len(whitening.variances) else F.array().cast("array<double>")
    long = whiten(grid, whitening).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(whitening.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
