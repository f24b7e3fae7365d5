"""Whitening of embeddings: exact covariance, FEAST eigenvectors, projection of every row.

Three passes of the table reduce it to fixed-size sums. Entries become integers, so the
sums of the first pass and the products of the second (taken around the rounded mean) are
exact whatever the order of tasks, and the covariance is rounded once. Its size is the
square of the dimension and does not grow with the rows.

The leading eigenvectors come from contour integration. A Householder reduction to
tridiagonal form gives inertia counts (how many eigenvalues lie above a point). They cut
the leading part of the spectrum into intervals of a few eigenvalues, at gaps. Each interval is a row of
a Spark table and solved by itself: Gauss-Legendre quadrature of ``(z - V)^-1 Y`` over a
circle through both ends projects a random block onto the interval's eigenvectors,
Rayleigh-Ritz extracts them, and the number of Ritz values inside must be the inertia
count; else the block grows, up to the whole space. The last pass projects the rows; the
covariance of what comes out is summed as well and compared with the identity.

Defined cases: null vectors and vectors with a null, NaN or infinite entry are left out, as are
vectors of another length than the most frequent one. Entries are held within 2**53 after
scaling. Repeated rows count each; a null id is passed on. Directions without variance
(eigenvalue below dimension * 2**-52 of the largest) cannot be whitened and give no component; one row, equal rows
and an empty table therefore give no rows. Repeated eigenvalues: any orthonormal basis. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.llm.vectors import common_length, exact_product, matrix, scaled, usable

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
LIMIT = 1 << 53
#: Eigenvalues of an interval, unless they are too close to be told apart.
BLOCK = 6
#: Quadrature points on the upper half of the circle.
POINTS = 8


class Whitening(NamedTuple):
    rows: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _vectors(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Usable rows, their entries as integers in ``x``, and the common length."""
    held = df.filter(usable(vector))
    length, _ = common_length(held, vector)
    return held.filter(F.size(vector) == length).withColumn("x", F.transform(scaled(vector, SCALE, LIMIT), lambda x: x + SHIFT)), length


def _total(sums: DataFrame, *keys: str) -> dict[tuple, int]:
    return {tuple(r[:-1]): int(r[-1]) for r in sums.groupBy(*keys).agg(F.sum("total").alias("total")).collect()}


def _column_sums(rows: DataFrame, length: int) -> tuple[int, list[int]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(length, object), 0
        for batch in batches:
            x = matrix(batch.column(0), length)
            n += len(x)
            totals += exact_product(np.ones((1, len(x)), np.int64), x)[0].astype(object)
        held = [*totals, n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-length, 1), pa.int32()), pa.array(held, pa.decimal128(38, 0))], names=["at", "total"]
        )

    sums = _total(rows.select("x").mapInArrow(add, "at int, total decimal(38,0)"), "at")
    return sums.get((0,), 0), [sums.get((i,), 0) for i in range(-length, 0)]


def _covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    length = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(length)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((length, length), object)
        for batch in batches:
            u = matrix(batch.column(0), length) - middle
            products += exact_product(u.T, u).astype(object)
        columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(list(products[upper]), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "total"])

    products = _total(rows.select("x").mapInArrow(multiply, "i int, j int, total decimal(38,0)"), "i", "j")
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((length, length))
    for (i, j), total in products.items():
        out[i, j] = out[j, i] = (n * total - rest[i] * rest[j]) / (n * n)
    return out


def tridiagonal(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = symmetric.astype(float).copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        norm = np.linalg.norm(x)
        if norm:
            v = x / norm
            a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues lie above each point of ``at``."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - at
    above = (pivot > 0).astype(int)
    for d, b in zip(diagonal[1:], beside, strict=True):
        pivot = d - at - b * b / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0
    return above


def intervals(symmetric: np.ndarray, wanted: int, block: int = BLOCK) -> list[tuple[float, float, int]]:
    """``low, high, eigenvalues inside`` that cover the ``wanted`` largest eigenvalues above rounding."""
    size = len(symmetric)
    diagonal, beside = tridiagonal(symmetric)
    reach = np.abs(np.r_[0.0, beside]) + np.abs(np.r_[beside, 0.0])
    top = float((diagonal + reach).max(initial=0.0))
    if top <= 0:
        return []
    top, least = top * (1 + 1e-9), top * size * 2.0**-52
    wanted = min(wanted, int(count_above(diagonal, beside, np.array([least]))[0]))
    ranks = np.arange(1, min(wanted + block, size) + 1)
    low, high = np.full(len(ranks), min(0.0, float((diagonal - reach).min())) - least), np.full(len(ranks), top)
    for _ in range(60):
        middle = (low + high) / 2
        inside = count_above(diagonal, beside, middle) >= ranks
        low, high = np.where(inside, middle, low), np.where(inside, high, middle)
    places = np.maximum((low + high) / 2, least)  # eigenvalue of each rank, largest first
    gaps = np.r_[places[:-1] - places[1:], places[-1] if len(ranks) == size else 0.0]
    cuts, start = [1.01 * places[0]], 0
    while start < wanted:
        stop = min(start + block, len(ranks))
        first = start + block // 2 if stop < wanted else wanted - 1
        best = first + int(np.argmax(gaps[first:stop]))
        while gaps[best] <= 1e-12 * top and best + 1 < len(ranks):  # equal eigenvalues stay together
            best += 1
        below = places[best + 1] if best + 1 < len(ranks) else (least if len(ranks) == size else places[best] - gaps.max(initial=top * 1e-9))
        cuts.append(max((places[best] + below) / 2, least / 2))
        start = best + 1
    held = count_above(diagonal, beside, np.array(cuts))
    return [(float(cuts[k + 1]), float(cuts[k]), int(held[k + 1] - held[k])) for k in range(len(cuts) - 1) if held[k + 1] > held[k]]


def feast(symmetric: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues of ``symmetric`` between ``low`` and ``high``, and their unit vectors as rows."""
    size = len(symmetric)
    norm = np.abs(symmetric).sum(axis=0).max()
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(-0.5j * np.pi * (nodes - 1))
    solves = [np.linalg.inv((centre + radius * t) * np.eye(size) - symmetric) for t in turns]
    projector = sum((w * radius * t * s).real for w, t, s in zip(weights, turns, solves, strict=True)) / 2
    width = min(size, inside + max(4, inside // 2))
    while True:
        block = np.random.default_rng(width).standard_normal((size, width))
        best = None
        for _ in range(40):
            basis = np.linalg.qr(projector @ block)[0] if width < size else np.eye(size)
            values, turned = np.linalg.eigh(basis.T @ symmetric @ basis)  # Rayleigh-Ritz
            block = basis @ turned
            within = (values > low) & (values < high)
            if within.sum() == inside:
                found, vectors = values[within], block[:, within]
                residual = np.abs(symmetric @ vectors - vectors * found).max(initial=0.0) / norm
                if best is None or residual < best[0]:
                    best = residual, found, vectors
                if residual < 4e-16 * size**0.5:
                    break
            if width == size:
                break
        if best is not None and best[0] < 1e-13 or width == size:
            if best is None:
                raise ArithmeticError(f"{inside} eigenvalues counted between {low} and {high}, other numbers found")
            return best[1], best[2].T
        width = min(size, 2 * width)


def leading(spark: SparkSession, symmetric: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding, largest first, and their vectors as rows; an interval is a row of work."""
    size = len(symmetric)
    scale = float(np.trace(symmetric)) if size else 0.0
    work = intervals(symmetric / scale, wanted) if scale > 0 else []
    if not work:
        return np.zeros(0), np.zeros((0, size))
    shared = spark.sparkContext.broadcast(symmetric / scale)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, vectors = feast(shared.value, low, high, inside)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(list(vectors), pa.list_(pa.float64()))], names=["value", "vector"]
                )

    table = spark.createDataFrame(work, "low double, high double, inside int").repartition(len(work))
    found = sorted(table.mapInArrow(solve, "value double, vector array<double>").collect(), key=lambda r: -r["value"])[:wanted]
    return np.array([r["value"] for r in found]) * scale, np.array([r["vector"] for r in found])


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean and leading components of all usable vectors."""
    rows, length = _vectors(df, vector)
    n, sums = _column_sums(rows, length)
    if not n or not length:
        return Whitening(n, sums, np.zeros(0), np.zeros((0, length)), 0.0)
    covariance = _covariance(rows, n, sums)
    values, vectors = leading(df.sparkSession, covariance, components)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def transform(df: DataFrame, model: Whitening, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vector_id, deviation decimal(38,0), whitened array<double>`` of every usable row of the model's length.

    ``deviation`` is the sum over dimensions of ``(n * x - S) ** 2``.
    """
    length, n = len(model.sums), model.rows
    middle = np.array([(2 * s + n) // (2 * n) if n else 0 for s in model.sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(model.sums, middle, strict=True)], object)
    projection = (model.vectors / np.sqrt(model.values)[:, None]).T
    count = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = matrix(batch.column(1), length) - middle
            bound = n * int(np.abs(u).max(initial=0)) + max(map(abs, rest), default=0)
            kind = np.int64 if bound * bound * length < 1 << 62 else object
            away = n * u.astype(kind) - rest.astype(kind)
            squares = list((away * away).sum(axis=1)) if kind is object else (away * away).sum(axis=1)
            deviation = pa.array(squares, pa.decimal128(38, 0) if kind is object else pa.int64())
            whitened = (u - (rest / n).astype(float)) @ projection
            ends = pa.array(np.arange(0, count * len(u) + 1, count, np.int32) if count else np.zeros(len(u) + 1, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), deviation.cast(pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, pa.array(whitened.reshape(-1)))],
                names=[vector_id, "deviation", "whitened"],
            )

    held = df.filter(usable(vector) & (F.size(vector) == length))
    x = F.transform(scaled(vector, SCALE, LIMIT), lambda x: x + SHIFT).alias("x")
    kind = df.schema[vector_id].dataType.simpleString()
    return held.select(vector_id, x).mapInArrow(project, f"`{vector_id}` {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest entry by which the covariance of ``whitened`` differs from the identity."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((components + 1, components + 1))
        for batch in batches:
            w = matrix(batch.column(0), components, np.float64)
            w = np.c_[w, np.ones(len(w))]
            sums += w.T @ w
        at = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums.reshape(-1))], names=["i", "j", "total"]
        )

    sums = np.zeros((components + 1, components + 1))
    for row in whitened.select("whitened").mapInArrow(multiply, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect():
        sums[row[0], row[1]] = row[2]
    n = sums[-1, -1]
    mean = sums[:-1, -1] / n
    return float(np.abs(sums[:-1, :-1] / n - np.outer(mean, mean) - np.eye(components)).max(initial=0.0))


def whiten(df: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component, the largest eigenvalue first."""
    model = fit(df, vector, components)
    projected = transform(df, model, vector_id, vector)
    error = identity_error(projected, len(model.values)) if len(model.values) else 0.0
    shares = F.lit((model.values / (model.trace or 1.0)).tolist()).cast("array<double>")
    spread = projected.select(vector_id, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select(
        vector_id,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.rows).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
