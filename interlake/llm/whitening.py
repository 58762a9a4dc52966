"""Embedding whitening: principal components by a randomised range finder, scaled to unit variance.

A random sketch with oversampling is drawn through the covariance by passes over all centred rows. Each
pass gives V @ Q of the orthonormal Q before it, and from that, with no further pass, the Rayleigh-Ritz
components within Q and their residuals. Where the residuals don't fall to rounding within the passes
allowed, as with a flat spectrum, Q is completed to all dimensions, in which the components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.llm._spark import checkpointed, only, sliced

PIECE = 1 << 14  # numbers of a sum that travel together
TINY = 2.0**-52


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: n rows, their sums (whole numbers), unit components by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # dims x k
    eigenvalues: np.ndarray
    trace: float
    residual: float
    passes: int
    complete: bool  # whether Q had to be completed to all dimensions
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def quantised(df: DataFrame, *, vector: str, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """Column `x`: floor(scale * c) + shift of each entry c as double, as array<long>; null where the vector is unusable.

    Unusable is a vector that is null, empty or holds a null, a non-finite entry or one whose x is beyond 2^62.
    """
    c = F.col(f"`{vector}`").cast("array<double>")
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v * scale) < float(1 << 62)), F.lit(False)))
    return df.withColumn("x", F.when(good, F.transform(c, lambda v: F.floor(v * scale).cast("long") + F.lit(shift).cast("long"))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dims)


def summed(rows: DataFrame, shape: tuple[int, ...], dtype: str, part: Callable[[Iterator[np.ndarray]], np.ndarray], dims: int) -> np.ndarray:
    """The sum over tasks of the array that `part` makes of a task's rows of `x`.

    Arrays travel in pieces of PIECE numbers and meet in two steps, in the square root of the number of tasks
    groups first, so no task and not the driver gets more than that many at a time.
    """
    size = math.prod(shape)
    kind = pa.int64() if dtype == "long" else pa.float64()
    schema = pa.schema([("piece", pa.int32()), ("salt", pa.int32()), ("data", pa.list_(kind))])
    salts = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def run(batches):
        from pyspark import TaskContext

        seen = [False]

        def blocks():
            for batch in sliced(batches, 4096):
                if batch.num_rows:
                    seen[0] = True
                    yield _matrix(batch.column(0), dims)

        flat = part(blocks()).ravel()
        salt = TaskContext.get().partitionId() % salts
        for at in range(0, size if seen[0] else 0, PIECE):
            piece = pa.array([flat[at : at + PIECE]], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.array([at // PIECE], pa.int32()), pa.array([salt], pa.int32()), piece], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        data = table["data"].combine_chunks()
        total = data.flatten().to_numpy(zero_copy_only=False).reshape(len(data), -1).sum(0)
        return pa.table([table["piece"].slice(0, 1), table["salt"].slice(0, 1), pa.array([total], pa.list_(kind))], schema=schema)

    listed = f"piece int, salt int, data array<{dtype}>"
    parts = rows.select("x").mapInArrow(run, listed).groupBy("piece", "salt").applyInArrow(merge, listed)
    out = np.zeros(size, np.int64 if dtype == "long" else np.float64)
    for row in parts.groupBy("piece").applyInArrow(merge, listed).collect():  # as many numbers as the array has
        out[row["piece"] * PIECE : row["piece"] * PIECE + len(row["data"])] = row["data"]
    return out.reshape(shape)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, with the difference taken in whole numbers."""
    return (n * x - sums) / float(n)


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of V within the span of Q by falling value, and the length of V u - e u of each; vq is V @ Q."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(vq @ turn - vectors * values, axis=0)


def range_finder(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, *, oversample: int = 16, passes: int = 6, tolerance: float = 1e-13, seed: int = 11) -> tuple:
    """(eigenvalues, vectors, largest residual, passes, whether all dimensions were taken) of the k largest of V.

    times(Q) gives V @ Q by one pass over the rows. Converged is a sketch whose k residuals are below `tolerance` times
    the largest eigenvalue. Passes end early once the residuals fall so slowly that those allowed can't suffice; then
    Q gets the missing dimensions and one more pass decides.
    """
    rng = np.random.default_rng(seed)
    width = min(dims, k + oversample)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    done, before = 0, None
    while True:
        vq = times(q)
        done += 1
        values, vectors, residuals = ritz(q, vq)
        top = min(k, len(values))
        worst, whole = float(residuals[:top].max(initial=0.0)), q.shape[1] == dims
        goal = tolerance * max(abs(float(values[0])), np.finfo(float).tiny)
        if whole or worst <= goal:
            return values[:top], vectors[:, :top], worst, done, whole
        rate = worst / before if before else 0.0
        if done >= passes or (before and (rate >= 1 or done + math.log(goal / worst) / math.log(rate) > passes)):
            more = rng.standard_normal((dims, dims - q.shape[1]))
            q = np.linalg.qr(np.concatenate([vectors, more], 1))[0]  # the whole space, its first axes near the components
            before = None
        else:
            q, before = np.linalg.qr(vq)[0], worst


def fit(rows: DataFrame, *, k: int = 16, oversample: int = 16, passes: int = 6, tolerance: float = 1e-13, seed: int = 11) -> Whitening | None:
    """Whitening of the rows' distinct `x` (arrays of whole numbers, null: left out); None where there is no row.

    All x must have one length: fit_and_apply() takes care of that. Equal vectors are one row of the fit, found by a
    shuffle that first drops repeats within tasks. The list of distinct vectors is written once to the shared folder; passes
    read it. A pass moves dims x (k + oversample) numbers a task, or dims x dims once all dimensions are taken.
    Components without variance (below rounding) are left out, so k is at most the rank.
    """
    distinct = checkpointed(rows.filter("x is not null").select("x").distinct())
    head = distinct.select(F.size("x").alias("dims")).first()
    if head is None:
        return None
    dims = head["dims"]

    def count(blocks):
        total = np.zeros(dims + 1, np.int64)
        for x in blocks:
            total[0] += len(x)
            total[1:] += x.sum(0)
        return total

    counted = summed(distinct, (dims + 1,), "long", count, dims)
    n, sums = int(counted[0]), counted[1:]

    def times(q: np.ndarray) -> np.ndarray:
        def part(blocks):
            total = np.zeros(q.shape)
            for x in blocks:
                c = centred(x, n, sums)
                total += c.T @ (c @ q)
            return total

        return summed(distinct, q.shape, "double", part, dims) / n

    def squares(blocks):
        return sum((np.square(centred(x, n, sums)).sum(0) for x in blocks), np.zeros(dims))

    trace = float(summed(distinct, (dims,), "double", squares, dims).sum() / n)
    values, vectors, residual, done, whole = range_finder(times, dims, min(k, dims), oversample=oversample, passes=passes, tolerance=tolerance, seed=seed)
    able = values > 8 * dims * TINY * max(float(values[0]), 0.0) if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    values, vectors = values[able], vectors[:, able]
    scaled = vectors / np.sqrt(values)

    def moments(blocks):
        total = np.zeros((len(values) + 1, len(values)))
        for x in blocks:
            w = centred(x, n, sums) @ scaled
            total[0] += w.sum(0)
            total[1:] += w.T @ w
        return total

    error = 0.0
    if len(values):
        got = summed(distinct, (len(values) + 1, len(values)), "double", moments, dims) / n
        error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(len(values))).max())  # means are of rounding's size here
    return Whitening(n, sums, vectors, values, trace, residual, done, whole, error)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2, exact; None beyond 2^63 - 1."""
    d = n * x - sums
    rough = np.square(d.astype(np.float64)).sum(1)
    out: list[int | None] = (d * d).sum(1).tolist()
    for i in np.flatnonzero(rough > float(1 << 62)).tolist():
        exact = sum(v * v for v in d[i].tolist())
        out[i] = exact if exact < 1 << 63 else None
    return out


def common_length(rows: DataFrame) -> int | None:
    """The length that most usable vectors have (the larger of several); None without any."""
    found = rows.filter("x is not null").groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return found["dims"] if found else None


def fit_and_apply(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, k: int = 16, **options) -> DataFrame:
    """(vec_id, n, deviation, whitened array<double>, explained array<double>, identity_error) of every usable row.

    Unusable vectors (see quantised()) are left out, as are those of another length than most have, for which there are no
    components. Repeated rows come out as often as they are in; vec_id may be null or repeated. Ties between eigenvalues leave the choice
    of components within them open. Other columns play no part. An empty table, or one without usable vectors, gives no row; a table of
    equal vectors has no variance and gives empty arrays. `deviation` is null where it doesn't fit a long. The model that goes to
    the tasks holds dims x k numbers, whatever the number of rows.
    """
    rows = quantised(only(df, vec_id=vec_id, vector=vector), vector="vector", scale=scale, shift=shift).filter("x is not null").select("vec_id", "x")
    dims = common_length(rows)
    rows = rows.filter(F.size("x") == (dims or 0))
    model = fit(rows, k=k, **options)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    listed = f"vec_id {id_type}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return rows.limit(0).selectExpr("vec_id", "0L n", "0L deviation", "array(0D) whitened", "array(0D) explained", "0D identity_error")
    n, sums, scaled, explained, error = model.n, model.sums, model.components / np.sqrt(model.eigenvalues), model.explained.tolist(), model.identity_error

    def apply(batches):
        for batch in sliced(batches, 4096):
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column(1), len(sums)), batch.num_rows
            white = (centred(x, n, sums) @ scaled).tolist()
            columns = [batch.column(0), pa.array([n] * rows, pa.int64()), pa.array(deviations(x, n, sums), pa.int64()), pa.array(white, pa.list_(pa.float64())), pa.array([explained] * rows, pa.list_(pa.float64())), pa.array([error] * rows, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, listed)


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    return whitened.select("vec_id", "n", "deviation", "identity_error", each.alias("at", "own")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("own.whitened").alias("whitened"), F.col("own.explained").alias("explained"), "identity_error"
    )
