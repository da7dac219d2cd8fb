"""Embedding whitening by a randomised range finder over all centred rows.

Vectors become whole numbers. One pass adds up their entries exactly. Power passes multiply the covariance with a random block of
directions (oversampled), each pass over all rows: a task centres its rows, adds up its own block and hands over one row per
dimension, which Spark adds up. Rayleigh-Ritz in the block's span gives components; if one of them is not an eigenvector to
double precision, the block is widened to the full dimension, where the span is everything and the result exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Components returned.
TOP = 8
#: Further directions of the random block.
OVER = 8
#: Passes of the covariance over the random block before Rayleigh-Ritz.
POWER = 2
#: A component passes if |V v - e v| is at most so much of the largest eigenvalue.
RESIDUAL = 1e-13
SEED = 12
#: Whole numbers beyond this size (entries of over 10^9) count as this one, so that sums stay within 64 bits.
MOST = 2.0**40
#: Entries that are multiplied at a time.
BLOCK = 1 << 20


def _sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v as array<double>) of the rows whose vector is whole and finite."""
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return slim.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's vectors as whole numbers, one row each; entries beyond MOST become the nearest within."""
    v = batch.column(1)
    flat = np.asarray(v.flatten(), np.float64).reshape(len(v), d)
    return np.clip(np.floor(1024 * flat), -MOST, MOST).astype(np.int64) + 100_000


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BLOCK // d)
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield part, whole(part, d)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once where n*x fits into 53 bits."""
    if len(x) and float(np.abs(x).max()) * n >= 2.0**53:
        return x - sums / n
    return (x * n - sums).astype(np.float64) / n


def _summed(rows: DataFrame, d: int, make: Callable, width: int) -> np.ndarray:
    """The sum over all tasks of ``make(x)``, a d by width matrix per block of rows, as one matrix of that shape."""
    schema = "i int, z array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        for _, x in blocks(batches, d):
            total += make(x)
        z = pa.ListArray.from_arrays(pa.array(np.arange(0, d * width + 1, width), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), z], names=["i", "z"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.asarray(batch.column(1).flatten()).reshape(len(batch), width)
            for i, row in zip(batch.column(0).to_pylist(), z):
                total[i] = total[i] + row if i in total else row.copy()
        for i, row in total.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "z": [row.tolist()]})

    out = np.zeros((d, width))
    for r in rows.mapInArrow(run, schema).repartition("i").mapInArrow(added, schema).collect():  # d rows of ``width`` numbers, whatever the vectors
        out[r["i"]] = r["z"]
    return out


def _sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, np.int64), 0
        for part, x in blocks(batches, d):
            total, n = total + x.sum(axis=0), n + len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d), pa.int32()), pa.array(np.concatenate([[n], total]), pa.int64())], names=["i", "s"])

    found = {r["i"]: r["s"] for r in rows.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()}  # one row per dimension
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(d)], np.int64)


def components(rows: DataFrame, d: int, n: int, sums: np.ndarray, k: int = TOP, over: int = OVER, power: int = POWER) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """(eigenvalues, unit eigenvectors as columns, trace of the covariance, whether the block was widened): largest first, at most ``k``."""
    width = min(d, k + over)

    def times(q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``, and its diagonal as a last column."""

        def make(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return np.column_stack([c.T @ (c @ q), np.einsum("ij,ij->j", c, c)])

        return _summed(rows, d, make, q.shape[1] + 1) / n

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Rayleigh-Ritz in the span of ``q``; the last value is the largest residual against the largest eigenvalue."""
        both = times(q)
        z, trace = both[:, :-1], both[:, -1].sum()
        b = q.T @ z
        e, w = np.linalg.eigh((b + b.T) / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        off = np.linalg.norm(z @ w - (q @ w) * e, axis=0).max() if k else 0.0
        return e, q @ w, trace, off / e[0] if e[0] > 0 else 0.0

    if width < d:
        q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
        for _ in range(power):
            q = np.linalg.qr(times(q)[:, :-1])[0]
        e, v, trace, off = ritz(q)
        if off <= RESIDUAL:
            return e, v, trace, False
    e, v, trace, _ = ritz(np.eye(d))
    return e, v, trace, True


def _identity_error(rows: DataFrame, d: int, n: int, sums: np.ndarray, axes: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance minus the identity: tasks' own means and centred products, joined exactly."""
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mean, prod = 0, np.zeros(k), np.zeros((k, k))
        for part, x in blocks(batches, d):
            w = centred(x, n, sums) @ axes
            own = w.mean(axis=0)
            shift, c = own - mean, w - own
            prod += c.T @ c + np.outer(shift, shift) * (m * len(part) / (m + len(part)))
            mean += shift * (len(part) / (m + len(part)))
            m += len(part)
        if m:
            yield pa.RecordBatch.from_pydict({"m": [m], "mean": [mean.tolist()], "prod": [prod.ravel().tolist()]})

    parts = staged(rows.mapInArrow(run, "m long, mean array<double>, prod array<double>"), "moments")
    means = {r["i"]: r["x"] / n for r in parts.select("m", F.posexplode("mean").alias("i", "x")).groupBy("i").agg(F.sum(F.col("m") * F.col("x")).alias("x")).collect()}
    mean = F.array(*[F.lit(float(means[i])) for i in range(k)])
    off = F.zip_with("mean", mean, lambda a, b: a - b)
    outer = F.flatten(F.transform(off, lambda a: F.transform(off, lambda b: a * b)))
    cells = parts.select(F.posexplode(F.zip_with("prod", outer, lambda p, o: p + F.col("m") * o)).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    cov = np.zeros(k * k)
    for r in cells.collect():  # k * k numbers
        cov[r["i"]] = r["x"] / n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, over: int = OVER, power: int = POWER) -> DataFrame:
    """One row per sound vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are those whose length is not the most
    frequent one (of equals the larger). Ids may be null or repeated, repeated rows count as often as they stand; other columns are
    ignored. Components without variance have no rows (a constant table gives none), and there are at most as many as dimensions.
    A deviation beyond 64 bits is null. An empty table gives no rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _sound(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = sizes["d"]
    rows = rows.where(F.size("v") == d)
    n, sums = _sums(rows, d)
    e, v, trace, _ = components(rows, d, n, sums, k, over, power)
    real = e > 1e-14 * max(trace, 0) if trace > 0 else np.zeros(len(e), bool)
    e, v = e[real], v[:, real]
    if not len(e):
        return spark.createDataFrame([], schema)
    # one sign, whatever the passes gave: the entry of largest size is positive
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    axes, shares, m = v / np.sqrt(e), e / trace, len(e)
    error = _identity_error(rows, d, n, sums, axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, d):
            fits = ((x.astype(np.float64) * n - sums) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            off = x * n - sums  # exact in the rows that fit, ignored in others
            deviation = pa.array((off * off).sum(axis=1).repeat(m), pa.int64(), mask=~fits.repeat(m))
            size, w = len(part), centred(x, n, sums) @ axes
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.arange(size).repeat(m))), pa.array(np.tile(np.arange(1, m + 1), size), pa.int32()), pa.array(np.full(size * m, n), pa.int64()), deviation,
                 pa.array(w.ravel()), pa.array(np.tile(shares, size)), pa.array(np.full(size * m, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
