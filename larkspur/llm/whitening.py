"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become whole numbers on a grid (``steps`` to 1, from ``OFFSET``), so that
sums and deviations are exact.  The components are fitted on each distinct
vector once: tasks centre blocks of rows and compress each block, with the
triangular factor so far, to a new factor R by QR; the tasks' factors are merged
by QR, MERGED at a time, until one is left, which has the singular values
and right singular vectors of all centred rows.  Plane rotations then make R's
columns orthogonal, many disjoint pairs at once; the rotations give the
components and the columns' norms the standard deviations, without ever forming
the covariance, whose smaller eigenvalues would lose half of their digits.

Plan at scale: the distinct vectors are one aggregation with partial sums by
task, so copies are dropped before the shuffle; sums, factors and the check of
the whitened covariance are a few numbers a task, added up on Spark; the driver
holds one d by d factor.  Whitening itself is one pass without a shuffle.

Nulls and edges: a vector that is null, empty, or holds a null or non-finite
entry is dropped, and so is one whose length isn't the most common one (the
longer of two as common), as it lacks entries or has too many; grid values beyond
2^52 are held there.  vec_id may be null or repeat, each row is whitened; ties
and copies count once in the fit.  Components whose variance is zero to double
precision can't be scaled to one and are left out, so that identical vectors, or
one, give no rows, like an empty table.  A deviation beyond a long is null.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import discard, materialise

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
FARTHEST = 1 << 52
#: Rows of a block, and factors merged by one task.
BLOCK, MERGED = 4096, 32
#: Sweeps at most, and the cosine below which two columns are orthogonal.
SWEEPS, ORTHOGONAL = 60, 1e-15


def on_grid(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", steps: int = STEPS, offset: int = OFFSET) -> DataFrame:
    """key and x (array of long) of the vectors that take part."""
    entries = F.col(f"`{column}`")
    sound = (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    place = lambda c: F.greatest(F.least(F.floor(c.cast("double") * steps), F.lit(FARTHEST)), F.lit(-FARTHEST)) + offset
    rows = vectors.where(entries.isNotNull() & sound).select(F.col(f"`{key}`").alias("vec_id"), F.transform(entries, place).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == lengths[0]["d"]) if lengths else rows


def blocks(batches: Iterator[pa.RecordBatch], column: int, rows: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
    """Batch-wise (start, end, matrix of whole numbers) of a column of arrays of one length."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.column(column).slice(start, rows)
            yield start, start + len(part), part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def sums(fit: DataFrame, offset: int = OFFSET) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension: one number a dimension and task, added up on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for start, end, x in blocks(batches, 0):
            x = x - offset
            part = x.sum(axis=0, dtype=np.int64) if np.abs(x).max() < 1 << 40 else x.astype(object).sum(axis=0)
            n, total = n + end - start, part.astype(object) + (0 if total is None else total)
        if n:
            dims = [-1, *range(len(total))]
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], names=["dim", "v"])

    found = {r["dim"]: int(r["v"]) for r in fit.select("x").mapInArrow(run, "dim int, v decimal(38,0)").groupBy("dim").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    n = found.pop(-1, 0)
    return n, [found[i] + n * offset for i in range(len(found))]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n: the difference of whole numbers is exact, and rounded once by the division."""
    return deviations(x, n, total).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where it fits, else in Python's integers."""
    s = np.array(total, object)
    near = [v // n for v in total]
    rest = (s - n * np.array(near, object)).tolist()  # 0 <= rest < n
    y = x - np.array(near, np.int64)
    if n * (float(np.abs(y).max(initial=0)) + 1) < 2**62:
        return n * y - np.array(rest, np.int64)
    return n * y.astype(object) - np.array(rest, object)


def square_sums(off: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row, None beyond a long."""
    rough = (off.astype(np.float64) ** 2).sum(axis=1)
    exact = np.zeros(len(off), np.int64)
    small = rough < 2**62
    exact[small] = (off[small].astype(np.int64) ** 2).sum(axis=1)
    found: list[int | None] = exact.tolist()
    for i in np.flatnonzero(~small):  # near the limit, or beyond it
        whole = sum(int(v) ** 2 for v in off[i]) if rough[i] < 2**64 else 1 << 63
        found[i] = whole if whole < 1 << 63 else None
    return found


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def factor(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the centred rows: one factor a task, merged MERGED at a time until one is left."""
    d = len(total)
    schema = "part long, r binary"

    def packed(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, _, x in blocks(batches, 0):
            rows = centred(x, n, total)
            r = _triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield packed(r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for found in batch.column(1).to_pylist():
                rows = np.frombuffer(found, "<f8").reshape(-1, d)
                r = _triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield packed(r)

    factors = materialise(fit.select("x").mapInArrow(compress, schema), "factors")
    while (count := factors.count()) > MERGED:
        fewer = materialise(factors.repartition(-(-count // MERGED), "part").mapInArrow(merge, schema), "factors")
        discard(factors)
        factors = fewer
    last = [np.frombuffer(r["r"], "<f8").reshape(-1, d) for r in factors.orderBy("part").collect()]  # at most MERGED
    discard(factors)
    return _triangle(np.vstack(last)) if last else np.zeros((0, d))


def pairings(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds in which each of d columns meets one other, every pair once."""
    ring = list(range(d + d % 2))
    found = []
    for _ in range(len(ring) - 1):
        pairs = [(min(p), max(p)) for p in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1], strict=True) if max(p) < d]
        found.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return found


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (as columns) of r, by plane rotations of its columns."""
    d = r.shape[1]
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    u, v = np.array(r, np.float64), np.eye(d)
    rounds = pairings(d)
    least = np.finfo(float).tiny
    for _ in range(SWEEPS if len(r) else 0):
        turned = False
        for a, b in rounds:
            x, y = u[:, a], u[:, b]
            p, q, g = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            far = np.abs(g) > np.maximum(ORTHOGONAL * np.sqrt(p) * np.sqrt(q), least)
            if not far.any():
                continue
            turned = True
            a, b, g, p, q = a[far], b[far], g[far], p[far], q[far]
            z = (q - p) / (2 * g)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (u, v):
                m[:, a], m[:, b] = c * m[:, a] - s * m[:, b], s * m[:, a] + c * m[:, b]
        if not turned:
            break
    sigma = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order] * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)[order]


def identity_error(fit: DataFrame, n: int, total: list[int], scaled: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity: k by k sums by task, added up on Spark."""
    k = scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((k, k))
        for _, _, x in blocks(batches, 0):
            z = centred(x, n, total) @ scaled
            product += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(product.ravel())], names=["at", "v"])

    found = fit.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    covariance = np.zeros(k * k)
    for r in found:
        covariance[r["at"]] = r["v"] / n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, steps: int = STEPS, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and component."""
    rows = materialise(on_grid(vectors, key, column, steps, offset), "grid-vectors")
    fit = materialise(rows.select("x").distinct(), "fit-vectors")
    n, total = sums(fit, offset)
    r = factor(fit, n, total) if n else np.zeros((0, len(total)))
    sigma, v = jacobi(r)
    # To double precision a column's norm is known to about its rounding errors, which are in proportion to the largest.
    known = sigma > len(sigma) * np.finfo(float).eps * sigma.max(initial=0)
    k = min(components, int(known.sum()))
    scaled = v[:, :k] * (np.sqrt(n) / sigma[:k]) if k else np.zeros((len(total), 0))
    explained = sigma[:k] ** 2 / (sigma**2).sum() if k else np.zeros(0)
    error = identity_error(fit, n, total, scaled) if k else 0.0
    discard(fit)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, x in blocks(iter([batch]), 1, BLOCK // max(k, 1) if k else BLOCK):
                if not k:
                    continue
                off = deviations(x, n, total)
                ids = batch.column(0).slice(start, end - start).take(pa.array(np.repeat(np.arange(end - start), k)))
                made = [
                    ids, np.tile(np.arange(1, k + 1, dtype=np.int32), end - start), np.full(len(ids), n),
                    pa.array(square_sums(off), pa.int64()).take(pa.array(np.repeat(np.arange(end - start), k))),
                    (off.astype(np.float64) / n @ scaled).ravel(), np.tile(explained, end - start), np.full(len(ids), error),
                ]
                yield pa.RecordBatch.from_arrays([m if isinstance(m, pa.Array) else pa.array(m) for m in made], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
