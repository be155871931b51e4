"""Whitening of embeddings by a covariance that comes from squares alone.

Components become whole numbers first (``floor(scale * c) + shift``), so that every sum is exact. With
``a`` and ``b`` two centred dimensions, ``(a + b)^2 = a^2 + 2ab + b^2``: the sums of squares of every
dimension and of every sum of two dimensions give all cross-products as differences,
``2 ab = (a + b)^2 - a^2 - b^2``. Tasks add up squares of their rows, Spark adds up the tasks' sums,
and ``d (d + 1) / 2`` numbers, whatever the number of rows, come to the driver, which assembles the
covariance and takes its eigenvectors.

Centring is exact too. A dimension is centred at the whole number below its mean, which keeps squares short,
and what is left of the mean, ``r / n`` with ``0 <= r < n``, is taken off by
``sum (n y - r)^2 = n (n sum y^2 - 2 r sum y) + n r^2``, in whole numbers of any length.

Vectors that are null, or hold nulls or numbers that aren't finite, take no part and have no result. So
do vectors whose length differs from the most frequent one (the longer of two equally frequent), and
those with a component beyond ``LIMIT / SCALE``, whose squares have no place in a decimal. Repeated rows count
each. An empty table, or one without usable vectors, gives an empty result. A component without variance
(equal vectors, fewer rows than dimensions) can't be scaled: its ``whitened`` is null and it has no part
in ``identity_error``. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMIT = 2.0**48  # keeps the sums of squares of 10^8 rows below 38 digits
SAFE = 1 << 62


def whole_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): usable vectors as arrays of whole numbers, written to the shared folder."""
    numbers = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LIMIT, F.lit(False)))
    rows = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & usable)
    made = rows.select(F.col(key).alias("id"), F.transform(numbers, lambda c: c + F.lit(shift).cast("long")).alias("x"))
    stored = materialize(made, "whole-vectors")
    usual = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return stored.filter(F.size("x") == (usual["d"] if usual else 0))


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def row_sums(y: np.ndarray) -> list[int]:
    """Exact column sums of whole numbers."""
    most = int(np.abs(y).max(initial=0)) + 1
    step = max(1, SAFE // most)
    return [sum(int(s) for s in (y[i : i + step, j].sum() for i in range(0, len(y), step))) for j in range(y.shape[1])]


def pair_squares(y: np.ndarray) -> list[int]:
    """Exact sums of ``(y_i + y_j)^2`` over the rows, for all ``i < j`` row by row, after those of ``y_i^2``."""
    d = y.shape[1]
    most = 4 * int(np.abs(y).max(initial=0)) ** 2 + 1
    if most > SAFE:
        y = y.astype(object)  # whole numbers of any length
    step = len(y) if most > SAFE else max(1, SAFE // most)
    totals = [0] * (d * (d + 1) // 2)
    for at in range(0, len(y), step):
        part = np.ascontiguousarray(y[at : at + step].T)
        sums = [int((c * c).sum()) for c in part]
        for i in range(d - 1):
            both = part[i + 1 :] + part[i]
            sums.extend(map(int, (both * both).sum(axis=1) if both.dtype == object else np.einsum("ij,ij->i", both, both)))
        totals = [a + b for a, b in zip(totals, sums, strict=True)]
    return totals


def added_up(rows: DataFrame, per_batch) -> list[int]:
    """Sums over all rows of a list of whole numbers that ``per_batch`` gives for a matrix of some rows."""

    def add(batches: Iterator[pa.RecordBatch]):
        totals: list[int] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                found = per_batch(matrix(batch.slice(at, 4096)))
                totals = found if totals is None else [a + b for a, b in zip(totals, found, strict=True)]
        if totals is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(totals)), pa.int32()), pa.array(list(map(str, totals)), pa.string())], names=["at", "total"]
            )

    parts = rows.select("x").mapInArrow(add, "at int, total string")
    sums = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [int(r["total"]) for r in sorted(sums.collect(), key=lambda r: r["at"])]


def fit(rows: DataFrame) -> tuple[int, list[int], np.ndarray] | None:
    """Number of rows, sums per dimension, and the covariance with divisor n; None without rows."""
    # Every task gives one number per dimension, and one per pair of dimensions.
    sums = added_up(rows, lambda x: [len(x), *row_sums(x)])
    if not sums:
        return None
    n, s = sums[0], sums[1:]
    floor = [v // n for v in s]
    rest = [v - n * f for v, f in zip(s, floor, strict=True)]
    centre = np.array(floor, np.int64)
    squares = added_up(rows, lambda x: pair_squares(x - centre))
    d = len(s)
    # Sums of squares of n * y - r, per dimension and per pair of dimensions.
    exact = lambda q, r: n * (n * q - 2 * r * r) + n * r * r  # noqa: E731  as sum y = r
    own = [exact(q, r) for q, r in zip(squares[:d], rest, strict=True)]
    cube = n**3
    covariance = np.zeros((d, d))
    at = d
    for i in range(d):
        covariance[i, i] = own[i] / cube
        for j in range(i + 1, d):
            both = exact(squares[at], rest[i] + rest[j])
            covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * cube)
            at += 1
    return n, s, covariance


def components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest, and unit eigenvectors as columns; the largest loading is positive."""
    if not len(covariance):
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1][:count]
    chosen = vectors[:, order]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))])
    return values[order], chosen * np.where(signs == 0, 1, signs)


def project(rows: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> DataFrame:
    """(id, deviation, whitened) of every row; ``axes`` hold the scaled components as columns."""
    floor = [s // n for s in sums]
    centre, rest = np.array(floor, np.int64), [s - n * f for s, f in zip(sums, floor, strict=True)]
    part = np.array([r / n for r in rest])

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            y = matrix(batch) - centre
            # n * x - S = n * y - r, and its squares, while they fit a long.
            most = n * (int(np.abs(y).max(initial=0)) + 1)
            fits = most * most * y.shape[1] < SAFE * 2
            far = y * n - np.array(rest, np.int64) if fits else y.astype(object) * n - np.array(rest, object)
            deviation = (far * far).sum(axis=1)
            scores = (y - part) @ axes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([str(int(v)) for v in deviation], pa.string()).cast(pa.decimal128(38, 0)),
                    pa.array(list(scores), pa.list_(pa.float64())),
                ],
                names=["id", "deviation", "whitened"],
            )

    return rows.mapInArrow(make, f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def identity_error(scores: DataFrame, n: int, used: int) -> float:
    """Largest absolute entry of the scores' covariance (divisor n, centred) minus the identity."""
    if not used:
        return 0.0
    size = used + 1

    def products(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((size, size))
        for batch in batches:
            w = matrix(batch, "whitened")
            w = np.hstack([np.ones((len(w), 1)), w[:, :used]])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size), pa.int32()), pa.array(total.ravel())], names=["at", "total"])

    sums = scores.select("whitened").mapInArrow(products, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    total = np.zeros(size * size)
    for row in sums.collect():
        total[row["at"]] = row["total"]
    total = total.reshape(size, size) / n
    covariance = total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:])
    return float(np.abs(covariance - np.eye(used)).max())


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is exact up to 38 digits.
    """
    rows = whole_vectors(df, vector, key)
    model = fit(rows)
    if model is None:
        n, sums, covariance = 0, [], np.zeros((0, 0))
    else:
        n, sums, covariance = model
    values, axes = components(covariance, count)
    trace = float(np.trace(covariance))
    # Below this an eigenvalue is zero but for rounding.
    real = values > trace * len(sums) * np.finfo(float).eps
    scaled = axes / np.sqrt(np.where(real, values, 1.0))
    scores = materialize(project(rows, n, sums, scaled), "whitened")
    used = int(real.sum())
    error = identity_error(scores, n, used)
    explained = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in np.maximum(values, 0)] or [F.lit(0.0)])
    each = scores.select("id", "deviation", F.posexplode("whitened").alias("at", "score"))
    return each.select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("at") < used, F.col("score")).alias("whitened"),
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
