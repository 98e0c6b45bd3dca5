"""Whitening of embeddings: streamed covariance, parallel merging, symmetric QR.

Vectors become whole numbers, floor(256 * c). The covariance is that of the distinct vectors, so copies of
one, however many, weigh as much as one. Each partition streams through Welford's update: a new vector
changes the mean and adds one rank-one term to the sum of centred products; the terms of a batch are
added by one matrix product. Partitions' states (count, exact sums, mean, products) are merged by the
parallel formula, `FAN` at a time on executors until few are left. The eigenvectors come from Householder
reflections to a tridiagonal matrix and implicit QR steps with Wilkinson's shift.

Memory: a task holds two states of d * d doubles, a merging task `FAN`, the driver `FAN`.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; rows without an id
and repeated rows are kept and whitened each; vectors shorter than the longest count as ending in zeros.
A component whose eigenvalue is zero within rounding has no scale: its `whitened` is null, and the identity
is told over the other components. There are as many components as dimensions, if those are fewer than
asked for; an empty table, or one of empty vectors, gives an empty result. `deviation` is null where it
doesn't fit 64 bits (about 3 million distinct vectors of 64 components); `deviation_exact` has it then too.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.tables import materialize
from inkfold.llm.vectors import matrix, padded, sizes, usable, whole

FAN = 16
STEP = 1024
STATE = "part long, n long, sums array<bigint>, mean array<double>, products array<double>"


@dataclass
class Moments:
    """Count, exact sums, mean and sum of centred products of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray) -> None:
        """Welford's update by each row of x in turn.

        Row k finds the mean of all before it; its rank-one term is the outer square of its distance to that
        mean, times (k - 1) / k. Whole numbers are summed exactly besides.
        """
        if np.issubdtype(x.dtype, np.integer):
            self.sums = [a + int(b) for a, b in zip(self.sums, x.sum(0, dtype=np.int64))]
        y = x.astype(np.float64) - self.mean
        before = self.n + np.arange(len(y), dtype=np.float64)[:, None]
        summed = np.cumsum(y, axis=0)
        apart = y - np.vstack([np.zeros(y.shape[1]), summed[:-1]]) / np.maximum(before, 1)
        self.products += (apart * (before / (before + 1))).T @ apart
        self.n += len(y)
        self.mean = self.mean + summed[-1] / self.n

    def merge(self, other: Moments) -> None:
        """The moments of both sets of vectors, by the parallel formula."""
        if not other.n:
            return
        n = self.n + other.n
        apart = other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n / n * other.n)
        self.mean = self.mean + apart * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, part: int) -> pa.RecordBatch:
        columns = [pa.array([part]), pa.array([self.n]), pa.array([self.sums], pa.list_(pa.int64())), pa.array([self.mean.tolist()], pa.list_(pa.float64())), pa.array([self.products.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["part", "n", "sums", "mean", "products"])


def _merged(table: pa.Table, d: int) -> Moments:
    total = Moments.none(d)
    for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
        total.merge(Moments(r["n"], r["sums"], np.array(r["mean"]), np.array(r["products"]).reshape(d, d)))
    return total


def moments(vectors: DataFrame, d: int, kind=np.int64) -> Moments:
    """Of the vectors in column x, each of d components. States are merged in a tree, so no task or driver holds all."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments.none(d)
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                own.add(matrix(batch.column("x").slice(k, STEP), d, kind))
        if own.n:
            yield own.row(TaskContext.get().partitionId())

    def join(group: pa.Table) -> pa.Table:
        own = _merged(group, d)
        return pa.Table.from_batches([own.row(group.column("part")[0].as_py() // FAN)])

    states = materialize(vectors.select("x").mapInArrow(stream, STATE), "moments")
    while states.count() > FAN:
        states = materialize(states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(join, STATE), "moments")
    return _merged(states.toArrow(), d)


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (rows) of a symmetric matrix; the largest entry of each is positive."""
    n = len(a)
    a, q = np.array(a, np.float64), np.eye(n)
    size = np.linalg.norm(a)
    for k in range(n - 2):  # a reflection that leaves one entry below the diagonal of column k
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    main, off = np.diag(a).tolist(), np.diag(a, -1).tolist()
    eps, last = np.finfo(float).eps, n - 1
    while last > 0:
        for i in range(last):
            if abs(off[i]) <= eps * max(abs(main[i]) + abs(main[i + 1]), size * eps):
                off[i] = 0.0
        if off[last - 1] == 0:
            last -= 1
            continue
        first = last - 1
        while first > 0 and off[first - 1] != 0:
            first -= 1
        half = (main[last - 1] - main[last]) / 2
        shift = main[last] - off[last - 1] ** 2 / (half + math.copysign(math.hypot(half, off[last - 1]), half))
        x, z = main[first] - shift, off[first]
        for k in range(first, last):  # rotations chase the bulge down the block
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                off[k - 1] = r
            m, e, w = main[k], off[k], main[k + 1]
            main[k] = c * c * m + 2 * c * s * e + s * s * w
            main[k + 1] = s * s * m - 2 * c * s * e + c * c * w
            off[k] = c * s * (w - m) + (c * c - s * s) * e
            if k < last - 1:
                x, z, off[k + 1] = off[k], s * off[k + 1], c * off[k + 1]
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
    order = np.argsort(-np.array(main), kind="stable")
    values, vectors = np.array(main)[order], q[order]
    sign = np.sign(vectors[np.arange(n), np.argmax(np.abs(vectors), axis=1)])
    return values, vectors * sign[:, None]


@dataclass
class Whitener:
    """What whitens a row: exact count and sums, the leading eigenvectors by their scale, and each one's share."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    shares: list[float]

    @classmethod
    def fitted(cls, m: Moments, components: int) -> Whitener:
        values, vectors = symmetric_qr(m.products / m.n)
        total, k = float(np.sum(np.diag(m.products)) / m.n), min(components, len(values))
        scale = np.array([1 / math.sqrt(e) if e > total * len(values) * np.finfo(float).eps else math.nan for e in values[:k]])
        return cls(m.n, np.array(m.sums, object), vectors[:k] * scale[:, None], [float(e) / total if total else 0.0 for e in values[:k]])

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        fits = max(self.n * max(1, int(np.abs(x).max(initial=0))), *(abs(int(s)) for s in self.sums), 1) < 2**62
        return self.n * x - self.sums.astype(np.int64) if fits else self.n * x.astype(object) - self.sums

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype(np.float64) / self.n) @ self.axes.T

    @staticmethod
    def deviations(apart: np.ndarray) -> list[int]:
        """Sums of squares, exactly: by halves of 26 bits each where that fits 64 bits, else by Python's integers."""
        if apart.dtype == object or (len(apart) and int(np.abs(apart).max(initial=0)) >= 2**51) or apart.shape[1] > 1024:
            return [sum(int(v) ** 2 for v in row) for row in apart]
        high, low = apart >> 26, apart & (2**26 - 1)
        parts = ((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts))]


def whiten(table: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each usable row and component: its place on the whitened axis, and what is said of the fit."""
    spark = table.sparkSession
    rows = table.select(key, vector).where(usable(F.col(vector)))
    shortest, d = sizes(rows, vector)
    x = whole(F.col(vector))
    rows = rows.select(key, (x if shortest == d else padded(x, d)).alias("x"))
    kind = rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if not d:
        return spark.createDataFrame([], out)
    fit = materialize(rows.select("x").distinct(), "fit")
    w = Whitener.fitted(moments(fit, d), components)
    sound = np.flatnonzero(np.isfinite(w.axes).all(1))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = w.whitened(w.apart(matrix(batch.column("x"), d)))[:, sound]
            yield pa.RecordBatch.from_arrays([pa.array(list(values), pa.list_(pa.float64()))], ["x"])

    error = 0.0
    if len(sound):
        m = moments(fit.mapInArrow(project, "x array<double>"), len(sound), np.float64)
        error = float(np.abs(m.products / m.n - np.eye(len(sound))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.shares)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                apart = w.apart(matrix(part.column("x"), d))
                exact = w.deviations(apart)
                values = w.whitened(apart).ravel()
                each = np.repeat(np.arange(len(apart)), k)
                n = len(each)
                columns = [
                    part.column(key).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(apart))),
                    pa.array(np.full(n, w.n, np.int64)),
                    pa.array([v if v < 2**63 else None for v in exact], pa.int64()).take(pa.array(each)),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(np.tile(w.shares, len(apart))),
                    pa.array(np.full(n, error)),
                    pa.array([Decimal(v) for v in exact], pa.decimal128(38)).take(pa.array(each)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(run, out.replace(f"{key} ", "vec ", 1)).withColumnRenamed("vec", key)
