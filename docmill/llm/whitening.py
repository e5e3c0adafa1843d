"""Whitening of embeddings by shifted Cholesky QR over distributed Gram passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize

#: Matrices are sent and added up in blocks of at most so many numbers.
CELLS = 4096
#: A direction of the first pass with less than this part of its unit length is a null direction.
NULL = 1e-6
ENOUGH = 1e-13


class Whitening(NamedTuple):
    """n fitted vectors, their sums for each dimension, components as columns, eigenvalues, their parts of the trace, passes made."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int


def whole_vectors(embeddings: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """embeddings with `x`, floor(scale * c) of each entry c; rows with a null vector or null or non-finite entries, and those of another length than most, are left out."""
    c = F.col(column)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    kept = embeddings.where(c.isNotNull() & ~bad & (F.size(c) > 0))
    lengths = kept.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = kept.where(F.size(c) == (lengths.d if lengths else 0))
    return kept.withColumn("x", F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def matrix_of(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """A batch's vectors as rows."""
    rows = batch.column(column)
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def added_up(df: DataFrame, one: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum of one(rows), an array of `size` numbers, over all batches of df's column x.

    Each task adds up its batches and sends blocks of at most 4,096 numbers, which meet in
    about the square root of the number of tasks first and then once more, so no task holds
    more than a block for each of those. The driver gets `size` numbers.
    """
    sum_type = np.float64 if kind == "double" else np.int64
    blocks = math.ceil(size / CELLS)
    tasks = max(1, df.rdd.getNumPartitions())
    roots = max(1, math.isqrt(tasks))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, sum_type)
        for b in batches:
            if b.num_rows:
                total += one(matrix_of(b)).reshape(-1)
        root = TaskContext.get().partitionId() % roots
        yield pa.RecordBatch.from_arrays(
            [pa.array([root] * blocks, pa.int64()), pa.array(range(blocks), pa.int64()), pa.array([total[i * CELLS : (i + 1) * CELLS].tolist() for i in range(blocks)], pa.list_(pa.from_numpy_dtype(sum_type)))],
            names=["root", "block", "values"],
        )

    def summed(t: pa.Table) -> pa.Table:
        total = 0
        for v in t.column("values").combine_chunks():
            total = total + v.values.to_numpy()
        return pa.table({"root": [t.column("root")[0].as_py()], "block": [t.column("block")[0].as_py()], "values": pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(sum_type)))})

    schema = f"root long, block long, values array<{kind}>"
    parts = df.select("x").mapInArrow(partial, schema)
    if roots > 1:
        parts = parts.groupBy("root", "block").applyInArrow(summed, schema)
    rows = parts.groupBy("block").applyInArrow(summed, schema).collect()
    out = np.zeros(size, sum_type)
    for r in rows:
        out[r.block * CELLS : r.block * CELLS + len(r["values"])] = r["values"]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less its means, with the whole parts of the means taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def fit(distinct: DataFrame, most_passes: int = 8) -> Whitening:
    """Principal components of the vectors x of a stored table of distinct ones.

    Method: with A the centred vectors as rows, a pass adds up the Gram matrix of A T, where T
    is the product of the triangular solves so far (none at first). The first Gram matrix is
    shifted by a small multiple of its trace, so that its Cholesky factor exists whatever the
    condition, the next ones are not; T takes each factor's inverse by a triangular solve,
    R its product. Passes go on until the Gram matrix is the identity to 1e-13 or no longer gets
    nearer (three passes as a rule). The singular values of R are A's, its right singular
    vectors the components.

    Directions in which the vectors don't vary have no length after the first pass and are
    dropped there; components are as many as there are others. Sums for each dimension are
    exact. The driver holds matrices of d times d for d dimensions, whatever the rows.
    """
    n = distinct.count()
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0)
    d = len(distinct.first().x)
    # Whole sums in two halves of 32 bits, so that no sum overflows.
    halves = added_up(distinct, lambda x: np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), 2 * d, "long")
    sums = [(int(high) << 32) + int(low) for high, low in zip(halves[:d], halves[d:], strict=True)]

    def gram(back: np.ndarray) -> np.ndarray:
        def one(x: np.ndarray) -> np.ndarray:
            q = centred(x, n, sums) @ back
            return q.T @ q

        k = back.shape[1]
        return added_up(distinct, one, k * k).reshape(k, k)

    back = r = np.eye(d)
    g = gram(back)
    trace = float(np.trace(g))
    if trace == 0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 1)
    upper = np.linalg.cholesky(g + np.eye(d) * (11 * d * (d + 1) * np.finfo(float).eps * np.linalg.norm(g, 2))).T
    back, r, passes, before = solved(back, upper), upper @ r, 1, np.inf
    while passes < most_passes:
        g, passes = gram(back), passes + 1
        if passes == 2:
            length, direction = np.linalg.eigh(g)
            if length[0] <= NULL:
                direction = direction[:, length > NULL]
                back, r, g = back @ direction, direction.T @ r, direction.T @ g @ direction
        off = float(np.abs(g - np.eye(len(g))).max())
        upper = np.linalg.cholesky(g).T
        back, r = solved(back, upper), upper @ r
        if off <= ENOUGH or passes > 3 and off > before / 2:
            break
        before = off
    singular, right = np.linalg.svd(r, full_matrices=False)[1:]
    values = singular**2 / n
    return Whitening(n, sums, right.T, values, values / (trace / n), passes)


def solved(back: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """back times the inverse of an upper triangular matrix, column by column."""
    out = np.empty_like(back)
    for j in range(len(upper)):
        out[:, j] = (back[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n * x - sums)^2 over each row, exact; None beyond a long."""
    if not len(x):
        return []
    most = max(max(abs(int(x.min())), abs(int(x.max()))) * n + abs(s) for s in sums)
    if most * most * len(sums) < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(embeddings: DataFrame, components: int = 4, column: str = "embedding") -> DataFrame:
    """Whitened coordinates of each vector of embeddings (vec_id, embedding).

    Entries c become x = floor(256 * c). The components are fitted on each distinct x once;
    see `fit`. Returns for each row that has a vector and each of up to `components`
    components: vec_id, component int (from 1, by falling eigenvalue), n long (distinct
    vectors), deviation long (sum of (n * x - sums)^2, exact), whitened double, explained
    double (the component's part of the variance), identity_error double (the largest
    difference of the whitened fit list's covariance from the identity, by a pass over it).

    Edge cases: rows with a null or empty vector or null or non-finite entries are left out,
    and so are rows of another dimension than most (of equally common ones the larger stays);
    repeated rows get rows of their own; equal x are fitted once. Entries beyond a long stop
    at its ends, a deviation beyond a long is null. Components without variance don't exist,
    so there can be fewer, and with fewer than two distinct vectors none and no rows. A null
    vec_id stays null. An empty table gives an empty result.

    Scale: vectors are read twice, and written once as distinct ones after a map-side
    combination, which each pass reads. Tasks hold one d times d matrix and a batch.
    """
    x = whole_vectors(embeddings, column)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = materialize(x.select("x").distinct(), "whitening-distinct")
    model = fit(distinct)
    k = min(components, len(model.eigenvalues))
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums = model.n, model.sums
    to = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])

    def moments(rows: np.ndarray) -> np.ndarray:
        w = centred(rows, n, sums) @ to
        return np.concatenate([(w.T @ w).reshape(-1), w.sum(axis=0)])

    both = added_up(distinct, moments, k * k + k) / n
    error = float(np.abs(both[: k * k].reshape(k, k) - np.outer(both[k * k :], both[k * k :]) - np.eye(k)).max())
    explained = model.explained[:k].tolist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            v = matrix_of(b)
            w = centred(v, n, sums) @ to
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(v, n, sums), pa.int64()).take(pa.array(at)),
                    pa.array(w.reshape(-1)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(rows, schema)
