"""Embedding whitening by shifted CholeskyQR.

Components become integers, ``floor(SCALE * c) + OFFSET``, and the model is fitted to each distinct vector
once. Its centred rows ``x - S / n`` are taken from the exact integers ``n * x - S``. A pass adds up
the Gram matrix of the rows, every task its share; the driver factors the (width x width) result into
``R' R`` and the next pass divides the rows by ``R`` through triangular solves. The first pass adds a
shift to the diagonal, so that Cholesky holds whatever the condition; the rows it leaves are close to
orthonormal, and further passes make them so to machine precision. The product of the triangles is the
R of the centred matrix, and its singular values and right vectors give variances and components.

The rows of a rank-deficient table stay in their subspace: directions without variance are found at
the end by their singular values and are no components. The orthogonalised rows are never stored; a
pass solves again from the integers.

Cases: rows whose vector is null or holds nulls or non-finite values are left out, and so are vectors
whose length differs from that of the smallest id. Repeated vectors count once in the fit and each row
gets its result. Without variance (no row, one distinct vector) there are no components, so the result
is empty. ``deviation`` is null where it does not fit 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .names import quoted
from .vectors import block, finite, folder, summed, written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
PASSES = 8
UNIT = np.finfo(np.float64).eps / 2
#: Rows taken at once inside a task.
AT_ONCE = 4096


def quantised(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, x``; components beyond 2 ** 40 stop there."""
    far = float(1 << 40)
    x = F.transform(quoted(vector), lambda c: F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), c.cast("double") * SCALE))).cast("long") + OFFSET)
    return rows.filter(finite(quoted(vector))).select(F.col(quoted(key)).alias("vec_id"), x.alias("x"))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n`` from exact integers."""
    return (n * x - sums) / np.float64(n)


def divided(rows: np.ndarray, triangles: list[np.ndarray]) -> np.ndarray:
    """The rows times the inverses of the triangles, by triangular solves."""
    for r in triangles:
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            some = whole.slice(at, AT_ONCE)
            yield some, block(some.column("x"), width)


def column_sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for _, x in blocks(batches, width):
            total += np.concatenate([x.sum(axis=0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["v"])

    out = np.zeros(width + 1, np.int64)
    for r in summed(fit.mapInArrow(run, "v array<long>"), [], "v"):
        out[r["pos"]] = r["total"]
    return int(out[-1]), out[:-1]


def gram(fit: DataFrame, width: int, n: int, sums: np.ndarray, finish, size: int) -> np.ndarray:
    """Sum over all rows of ``z' z`` for ``z = finish(centred row)`` of ``size`` values; every task sends one matrix, by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in blocks(batches, width):
            z = finish(centred(x, n, sums))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    out = np.zeros((size, size))
    for r in summed(fit.mapInArrow(run, "i int, v array<double>"), ["i"], "v"):
        out[r["i"], r["pos"]] = r["total"]
    return (out + out.T) / 2


def triangle(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangle R with R' R = G, or G plus a shift where G alone has no such factor."""
    d = len(g)
    scale = max(float(np.linalg.eigvalsh(g)[-1]), np.finfo(float).tiny)
    shift = min(11 * (n * d + d * (d + 1)) * UNIT, 0.1) * scale
    if not shifted:
        try:
            r = np.linalg.cholesky(g).T
            if np.diag(r).min() > np.sqrt(100 * d * UNIT * scale):
                return r
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(g + shift * np.eye(d)).T


@dataclass
class Whitening:
    """What ``fit`` found: centre (``sums / n``), components by falling variance as columns, their variances, the trace."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    trace: float
    passes: int


def fit_components(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """None if the rows have no variance."""
    n, sums = column_sums(fit, width)
    if n < 2:
        return None
    triangles: list[np.ndarray] = []
    for turn in range(PASSES):
        g = gram(fit, width, n, sums, lambda rows: divided(rows, triangles), width)
        if turn == 0 and not np.trace(g) > 0:
            return None
        # done when what is left is orthonormal, or nothing
        spectrum = np.linalg.eigvalsh(g)
        if turn and np.all((np.abs(spectrum - 1) < 50 * width * UNIT) | (spectrum < 1e-9)):
            break
        triangles = [*triangles, triangle(g, n, shifted=turn == 0)]
    r = np.eye(width)
    for t in triangles:
        r = t @ r
    _, size, axes = np.linalg.svd(r)
    variance = size**2 / n
    real = int((size > size[0] * width * 1e-11).sum())
    k = min(components, real)
    return Whitening(n, sums, axes[:k].T.copy(), variance[:k], float(variance[:real].sum()), len(triangles))


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component."""
    spark = rows.sparkSession
    ready = quantised(rows, key, vector)
    kind = ready.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    one = ready.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    width = len(one[0]["x"]) if one else 0
    if not width:
        return spark.createDataFrame([], schema)
    ready = ready.filter(F.size("x") == width)
    fit = written(ready.select("x").distinct(), folder(spark, "whitening"))
    model = fit_components(fit, width, components)
    if model is None:
        return spark.createDataFrame([], schema)
    n, sums, k = model.n, model.sums, len(model.variance)
    project = model.axes / np.sqrt(model.variance)
    covariance = gram(fit, width, n, sums, lambda x: x @ project, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = model.variance / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in blocks(batches, width):
            apart = n * x - sums
            fits = (apart.astype(np.float64) ** 2).sum(axis=1) < 9e18
            deviation = (apart**2).sum(axis=1)
            z = (apart / np.float64(n)) @ project
            rows_of = np.repeat(np.arange(len(x)), k)
            count = len(rows_of)
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("vec_id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(count, n), pa.int64()), pa.array(deviation[rows_of], pa.int64(), mask=~fits[rows_of]),
                    pa.array(z.ravel(), pa.float64()), pa.array(np.tile(explained, len(x)), pa.float64()), pa.array(np.full(count, error), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return spread(ready).mapInArrow(run, schema)
