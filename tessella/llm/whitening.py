"""Embedding whitening: principal components without ever forming the covariance matrix.

Vectors become integers ``floor(64 * entry) + 1000000``.  The fit list holds each distinct integer vector once;
its sums, and from them the trace of its covariance, are exact integers.  The components come from block
Lanczos with full reorthogonalisation: a pass over the fit list multiplies its centred rows X with a block of
vectors, the sum over partitions of ``X'(X block)``, and the driver keeps the basis and its image, ``2 d^2``
numbers at most.  A block whose new part vanishes (breakdown) is filled up with random vectors, so that
equal eigenvalues and small invariant spaces lose nothing.  It ends when the residual of every wanted pair is
at most ``TOLERANCE`` of the largest eigenvalue, or when the basis spans the whole space.

Rows whose vector is null, or has a null or non-finite entry, go; all others stay, repeated ones and null keys
too.  A vector shorter than the longest one is filled up with zeros.  Entries beyond 2^46 count as 2^46.  A
component without variance has a null ``whitened`` and explains 0.  A ``deviation`` that no long can hold is
null.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._util import discard, slim, staged

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, float(1 << 46)
COMPONENTS, BLOCK = 16, 16
#: Residual of a pair as a share of the largest eigenvalue at which it counts as found.
TOLERANCE = 1e-14
#: Groups in which the sums of partitions are added before the driver adds those of the groups.
GROUPS = 64
_LONG = 1 << 63


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite entries."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integers(vector: Column) -> Column:
    """The entries as integers.  Written in expressions, so that distinct vectors are found without Python."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE) + F.lit(SHIFT).cast("long"))


def padded(x: Column, dim: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.greatest(F.lit(dim) - F.size(x), F.lit(0))))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of ``dim`` longs a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def summed(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """The sum over partitions of the one-dimensional array that ``part`` makes of each; Python integers stay exact.

    Partitions are added in ``GROUPS`` groups by tasks and these by the driver, always in the same order, so that
    neither holds an array of every partition.
    """

    def write(x: np.ndarray) -> pa.Array:
        return pa.array([list(map(str, x)) if x.dtype == object else list(map(float.hex, x.tolist()))], pa.list_(pa.string()))

    def read(x: list[str]) -> np.ndarray:
        return np.array([float.fromhex(v) for v in x]) if x and "x" in x[0] else np.array([int(v) for v in x], object)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at % GROUPS], pa.int32()), pa.array([at], pa.int32()), write(part(batches))], ["g", "p", "x"])

    def second(table: pa.Table) -> pa.Table:
        some = table.sort_by("p")
        total = None
        for x in some.column("x"):
            own = read(x.as_py())
            total = own if total is None else total + own
        return pa.table([some.column("g").slice(0, 1), write(total)], ["g", "x"])

    total = None
    for r in df.mapInArrow(first, "g int, p int, x array<string>").groupBy("g").applyInArrow(second, "g int, x array<string>").orderBy("g").collect():  # GROUPS rows
        total = read(r.x) if total is None else total + read(r.x)
    return total


def lanczos(apply: Callable[[np.ndarray], np.ndarray], dim: int, k: int = COMPONENTS, block: int = BLOCK, seed: int = 17, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    The symmetric matrix is known only by ``apply``, which multiplies it with a block of columns.  A block has
    ``k`` columns at least, so that it meets every one of ``k`` equal eigenvalues.
    """
    block = max(block, k)
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    fresh = rng.standard_normal((dim, block))
    while True:
        new = _extended(basis, fresh, rng)
        basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
        found = basis @ turns
        residual = np.linalg.norm(image @ turns - found * values, axis=0)
        if basis.shape[1] == dim or len(values) == k and residual.max() <= tolerance * max(values[0], 0):
            return values, found / np.linalg.norm(found, axis=0)
        fresh = image[:, -new.shape[1] :]


def _extended(basis: np.ndarray, fresh: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit columns orthogonal to the basis and to each other that go on from ``fresh``; random ones where nothing new is left."""
    dim, width = fresh.shape
    new: list[np.ndarray] = []
    for column in fresh.T[: dim - basis.shape[1]]:
        before = np.column_stack([basis, *new])
        size = np.linalg.norm(column)
        while True:
            for _ in range(2):  # twice is enough
                column = column - before @ (before.T @ column)
            if (now := np.linalg.norm(column)) > 1e-10 * size:
                break
            column = rng.standard_normal(dim)  # breakdown
            size = np.linalg.norm(column)
        column = column / now
        new.append((column - before @ (before.T @ column)) / np.linalg.norm(column - before @ (before.T @ column)))
    return np.column_stack(new)


class Whitening:
    """What a fit leaves: number and sums of distinct vectors, components, eigenvalues, trace, identity error."""

    def __init__(self, n: int, sums: list[int], trace: float, values: np.ndarray, components: np.ndarray):
        self.n, self.sums, self.trace, self.values, self.components, self.identity_error = n, sums, trace, values, components, 0.0
        self.live = values > len(sums) * np.finfo(float).eps * max(values[0], 0)

    @property
    def explained(self) -> np.ndarray:
        return np.where(self.live, self.values / (self.trace or 1.0), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the roots of the eigenvalues; not a number where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, centred(x, self.n, self.sums) @ self.components / np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)


def multiples(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: longs where they can hold it, else Python integers."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
    if most < _LONG >> 1:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (multiples(x, n, sums) / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of squares of ``n * x - S``; None where a long cannot hold one."""
    m = multiples(x, n, sums)
    near = (m.astype(float) ** 2).sum(1)
    if m.dtype != object and near.max(initial=0) < 0.99 * _LONG:
        return (m * m).sum(1).tolist()
    return [None if rough > 1.01 * _LONG or (v := sum(int(c) ** 2 for c in row)) >= _LONG else v for row, rough in zip(m, near, strict=True)]


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector of the column ``v`` once; None without any."""
    listed = staged(vectors.select(integers(F.col("v")).alias("x")).distinct(), "vectors")
    short, dim = listed.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not dim:
        discard(listed)
        return None
    if short < dim:
        ragged, listed = listed, staged(listed.select(padded(F.col("x"), dim).alias("x")).distinct(), "vectors")
        discard(ragged)
    rows = slim(listed)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 + 2 * dim, object)
        for batch in batches:
            y = _rows(batch.column(0), dim) - SHIFT
            most = int(np.abs(y).max(initial=0))
            y = y if most * most * max(len(y), 1) < _LONG else y.astype(object)
            total = total + np.array([len(y), *y.sum(0).tolist(), *(y * y).sum(0).tolist()], object)
        return total

    total = summed(rows, count)
    n, first, second = int(total[0]), [int(v) for v in total[1 : dim + 1]], [int(v) for v in total[dim + 1 :]]
    sums = [v + n * SHIFT for v in first]
    trace = sum(n * b - a * a for a, b in zip(first, second, strict=True)) / n**2  # all deviations' sum, n times this one, over n^3

    def product(block: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(block.shape)
            for batch in batches:
                c = centred(_rows(batch.column(0), dim), n, sums)
                out += c.T @ (c @ block)
            return out.ravel()

        return summed(rows, part).reshape(block.shape) / n

    values, components = lanczos(product, dim, min(k, dim))
    fitted = Whitening(n, sums, trace, values, components)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        width = int(fitted.live.sum())
        total = np.zeros(width * (width + 1))
        for batch in batches:
            w = fitted.whitened(_rows(batch.column(0), dim))[:, fitted.live]
            total += np.concatenate([(w.T @ w).ravel(), w.sum(0)])
        return total

    if fitted.live.any():
        total = summed(rows, moments) / n
        width = int(fitted.live.sum())
        mean = total[width * width :]
        fitted.identity_error = float(np.abs(total[: width * width].reshape(width, width) - np.outer(mean, mean) - np.eye(width)).max())
    discard(listed)
    return fitted


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each kept vector and component.

    The fit shuffles distinct vectors once; the result itself is made without a shuffle.
    """
    own = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(usable(F.col("v")))
    kind = df.schema[key].dataType.simpleString()
    fitted = fit(own, k)
    schema = f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("k", key)
    dim, width = len(fitted.sums), len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            rows, x = batch.num_rows, _rows(batch.column(1), dim)
            w = fitted.whitened(x).ravel()
            every = pa.array(np.repeat(np.arange(rows), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(every), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)), pa.array(np.full(len(w), fitted.n)),
                    pa.array(deviations(x, fitted.n, fitted.sums), pa.int64()).take(every), pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(fitted.explained, rows)), pa.array(np.full(len(w), fitted.identity_error)),
                ],
                ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return slim(own.select("k", padded(integers(F.col("v")), dim).alias("x"))).mapInArrow(run, schema).withColumnRenamed("k", key)
