"""Embedding whitening: pivoted Cholesky, then one-sided Jacobi on the factor.

Entries become fixed-point numbers, so equal vectors are equal exactly and every
vector counts once in the fit. Spark sums the fit list, then the scatter of the
centred vectors (one matrix a task, added row by row); what reaches the driver
is one dims x dims matrix, whose size does not depend on the rows. There the
scatter is factored with diagonal pivoting into a lower trapezoid L, and plane
rotations from the right make L's columns orthogonal: squared column norms are
the eigenvalues and normalised columns the components. Whitening is one more
pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, spread, stash

SCALE = 256
COMPONENTS = 4
TINY = 1e-13                   # a pivot under this share of the largest ends the factorisation
SLICE = 1 << 21                # entries of a dense block inside a task


def fixed_point(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * entry)`` as longs; null where the vector is null or holds
    a null or non-finite entry. Entries past the range of a long are held at
    its ends."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale))))


def _dense(column: pa.Array, dims: int, kind=np.int64) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks ``(first row, matrix)`` of a list column; short vectors end in zeros."""
    step = max(1, SLICE // max(1, dims))
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        counts = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        if len(counts) and (counts == dims).all():
            yield at, flat.reshape(-1, dims).astype(kind)
            continue
        out = np.zeros((len(counts), dims), kind)
        row = np.repeat(np.arange(len(counts)), counts)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
        yield at, out


def _partial_sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for batch in batches:
            for _, x in _dense(batch.column("x"), dims):
                n += len(x)
                # halves of 32 bits, so that no block overflows
                high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                                              pa.array([str(t) for t in total])], ["dim", "n", "s"])
    return run


def _partial_scatter(mean: np.ndarray):
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        seen = False
        for batch in batches:
            for _, x in _dense(batch.column("x"), dims):
                y = x - mean
                total += y.T @ y
                seen = True
        if seen:
            yield from _matrix_rows(range(dims), total)
    return run


def _matrix_rows(names, rows) -> Iterator[pa.RecordBatch]:
    names = list(names)
    step = max(1, SLICE // max(1, len(rows[0])))
    for at in range(0, len(names), step):
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[at:at + step], pa.int32()), pa.array([r.tolist() for r in rows[at:at + step]],
                                                               pa.list_(pa.float64()))], ["dim", "row"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of equal ``dim``, which come one after the other."""
    at, total = None, None
    for batch in batches:
        for dim, row in zip(batch.column("dim").to_pylist(), batch.column("row")):
            row = np.array(row.values, np.float64)
            if dim == at:
                total = total + row
                continue
            if at is not None:
                yield from _matrix_rows([at], [total])
            at, total = dim, row
    if at is not None:
        yield from _matrix_rows([at], [total])


def pivoted_cholesky(matrix: np.ndarray, tiny: float = TINY) -> np.ndarray:
    """``L`` (dims x rank) with ``L L^T`` equal to the symmetric positive
    semidefinite ``matrix``; pivots are the largest remaining diagonals, and the
    factor ends where they are rounding noise. Rows keep the input's order, so
    L is a lower triangle up to that permutation."""
    left = np.array(matrix, np.float64)
    diagonal = np.diag(left).copy()
    floor = tiny * max(diagonal.max(initial=0.0), 0.0)
    columns = []
    free = np.ones(len(left), bool)
    for _ in range(len(left)):
        p = int(np.argmax(np.where(free, diagonal, -np.inf)))
        if diagonal[p] <= floor:
            break
        column = left[:, p].copy()
        for c in columns:
            column -= c[p] * c
        column[~free] = 0.0
        column[p] = diagonal[p]
        column /= np.sqrt(diagonal[p])
        free[p] = False
        diagonal = diagonal - column ** 2
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((len(left), 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and components (columns) of ``factor factor^T``.

    Pairs of columns are rotated until all are orthogonal to rounding. A round
    rotates disjoint pairs at once, in tournament order; norms are taken anew in
    each round. Columns that vanish carry no component."""
    u = np.array(factor, np.float64, order="F")
    k = u.shape[1]
    seats = list(range(k)) + [-1] * (k % 2)
    half = len(seats) // 2
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(max(1, len(seats) - 1)):
            pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1:-1]) if a >= 0 and b >= 0]
            if pairs:
                i, j = (np.array(x) for x in zip(*pairs))
                a, b = u[:, i], u[:, j]
                aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
                scale = np.sqrt(aa * bb)
                off = np.abs(ab) > 1e-16 * scale
                largest = max(largest, float(np.max(np.abs(ab[off]) / scale[off], initial=0.0)))
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    zeta = (bb - aa) / (2 * ab)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                t = np.where(off & np.isfinite(t), t, 0.0)
                c = 1 / np.hypot(1.0, t)
                s = c * t
                u[:, i], u[:, j] = c * a - s * b, s * a + c * b
            seats = [seats[0], seats[-1], *seats[1:-1]] if len(seats) > 2 else seats
        if largest < 1e-15:
            break
    norms = np.sqrt((u * u).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, u[:, order] / norms[order]


@dataclass(frozen=True)
class Whitener:
    """Fit of a table: ``n`` distinct vectors, their exact ``sums`` per
    dimension, ``values`` (eigenvalues, falling), ``components`` (columns) and
    the ``trace`` of the covariance."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def valid_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows with a vector of finite entries, and ``x``, its fixed-point form
    (an input column of that name is replaced)."""
    return rows.withColumn("x", fixed_point(F.col(f"`{vector}`"), scale)).where("x is not null")


def fit(valid: DataFrame, components: int = COMPONENTS) -> tuple[Whitener, DataFrame]:
    """Whitener of ``valid(x)``, and its written fit list.

    Every distinct vector counts once, however often it comes: copies are
    combined before the shuffle. Vectors shorter than the longest count as
    ending in zeros. Directions without variance carry no component, so a table
    with one distinct vector, or none, has none."""
    distinct = stash(valid.select("x").distinct(), "whiten-fit")
    dims = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return Whitener(0, (), np.zeros(0), np.zeros((0, 0)), 0.0), distinct
    sums = in_arrow(distinct, _partial_sums(dims), "dim int, n long, s string").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted((r["dim"], r["n"], int(r["s"])) for r in sums.collect())       # dims rows
    n, totals = found[0][1], tuple(s for _, _, s in found)
    mean = np.array([s / n for s in totals])
    parts = in_arrow(distinct, _partial_scatter(mean), "dim int, row array<double>")
    whole = in_arrow(parts.repartition(spread(distinct), "dim").sortWithinPartitions("dim"), _add_rows,
                     "dim int, row array<double>")
    matrix = np.zeros((dims, dims))
    for r in whole.collect():                                                     # dims x dims numbers
        matrix[r["dim"]] = r["row"]
    covariance = (matrix + matrix.T) / (2 * n)
    values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
    return Whitener(n, totals, values[:components], vectors[:, :components], float(np.trace(covariance))), distinct


def _project(model: Whitener, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    mean, weights = model.mean, model.weights
    for at, x in _dense(batch.column("x"), len(mean)):
        yield at, x, (x - mean) @ weights


def identity_error(model: Whitener, distinct: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus
    the identity (0.0 without a component); the sums are Spark's centred ones."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, z in _project(model, batch):
                yield pa.RecordBatch.from_arrays([pa.array(z[:, i]) for i in range(k)], [f"z{i}" for i in range(k)])
    z = in_arrow(distinct, run, ", ".join(f"z{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = z.agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def _deviation(model: Whitener, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S)^2``, exact; null past a long."""
    n, sums = model.n, model.sums
    reach = max(int(np.abs(x.astype(np.float64)).max(initial=0.0)) * n + max(map(abs, sums), default=0), 1)
    if 2 * reach * reach * max(1, x.shape[1]) < 1 << 62:
        y = x * n - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    found = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in found]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``
    for every row of ``rows`` with a usable vector and every component up to
    ``components`` that has variance.

    Rows whose vector is null, or holds a null or non-finite entry, have no
    output; a null key stays null and repeated rows are repeated. Shorter
    vectors count as ending in zeros. With fewer than two distinct vectors, and
    for an empty table, no row comes out. ``deviation`` is null where it
    exceeds a long. Other input columns are not read, whatever their names."""
    read = rows.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_vector"))
    valid = valid_vectors(read, "_vector").select("_key", "x")
    model, distinct = fit(valid, components)
    error = identity_error(model, distinct)
    k = len(model.values)
    share = model.values / model.trace if k else model.values
    type_of_key = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, z in _project(model, batch):
                keys = batch.column("_key").slice(at, len(x))
                each = np.repeat(np.arange(len(x)), k)
                size = len(each)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(size, model.n, np.int64)),
                     pa.array(_deviation(model, x), pa.int64()).take(pa.array(each)),
                     pa.array(z.reshape(-1)), pa.array(np.tile(share, len(x))), pa.array(np.full(size, error))],
                    ["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    schema = (f"_key {type_of_key.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if not k:
        return valid.sparkSession.createDataFrame([], schema).withColumnRenamed("_key", key)
    return in_arrow(valid, run, schema).withColumnRenamed("_key", key)


def contract(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
