"""Whitening of embeddings.

Partitions take up the distinct vectors one by one with Welford's rank-one updates; their
moments are merged by the parallel formula, level by level, and the one state that is left
is solved by the symmetric QR method.  Nothing but that state comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed value: entries become whole multiples of 1/256.
SCALE = 256.0
#: States that one task merges, about.
MERGED_AT_ONCE = 32
#: Bytes of all merged states that the driver takes, at most (a state has dims² doubles).
STATE_BYTES = 256 << 20
STATE = "dims int, part long, n long, sums array<decimal(38,0)>, mean array<double>, m2 array<double>"
LONG_MAX = 2**63 - 1


class Moments:
    """Count, exact sums, means and summed products of deviations of the vectors so far."""

    def __init__(self, dims: int):
        self.n, self.sums, self.mean, self.m2 = 0, [0] * dims, np.zeros(dims), np.zeros((dims, dims))

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        off = x - self.mean
        self.mean += off / self.n
        self.m2 += off[:, None] * (x - self.mean)

    def merge(self, other: Moments) -> None:
        if not other.n:
            return
        n, off = self.n + other.n, other.mean - self.mean
        self.m2 += other.m2 + (off[:, None] * off) * (self.n * other.n / n)
        self.mean += off * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, part: int) -> tuple:
        from decimal import Decimal

        return len(self.mean), part, self.n, [Decimal(s) for s in self.sums], self.mean.tolist(), self.m2.ravel().tolist()

    @classmethod
    def of(cls, row) -> Moments:
        m = cls(len(row.mean))
        m.n, m.sums, m.mean = int(row.n), [int(s) for s in row.sums], np.array(row.mean, float)
        m.m2 = np.array(row.m2, float).reshape(len(m.mean), -1) if len(m.mean) else np.zeros((0, 0))
        return m


def usable(column: str) -> Column:
    """Whether a vector is there, without null or non-finite entries."""
    whole = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & whole


def quantised(column: str) -> Column:
    """floor(256 c) of every entry as longs, which stop at the ends of their range."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def vectors(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, row numbers, matrix) for each length of vector in a batch without nulls."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        yield int(dims), rows, flat[begins[rows][:, None] + np.arange(dims)]


def moments(table: DataFrame, column: str, work=None) -> DataFrame:
    """One state for each length of vector: of a column of long vectors, or of what
    ``work(dims, matrix)`` makes of them."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        found: dict[int, Moments] = {}
        for batch in batches:
            for dims, _, x in vectors(batch, column):
                values = x.astype(float) if work is None else work(dims, x)
                if dims not in found:
                    found[dims] = Moments(values.shape[1])
                state = found[dims]
                for value in values:
                    state.add(value)
                if work is None:
                    big = dims and len(x) * int(np.abs(x.astype(object)).max()) > LONG_MAX
                    state.sums = [a + int(b) for a, b in zip(state.sums, (x.astype(object) if big else x).sum(0))]
        part = TaskContext.get().partitionId()
        rows = [(dims, *m.row(part)[1:]) for dims, m in found.items()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["dims", "part", "n", "sums", "mean", "m2"]), schema=_ARROW, preserve_index=False)

    parts = stored(table.select(column).mapInArrow(states, STATE), "moments")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("part").itertuples())
        total = Moments.of(rows[0])
        for row in rows[1:]:
            total.merge(Moments.of(row))
        return pd.DataFrame([(rows[0].dims, *total.row(rows[0].part)[1:])], columns=["dims", "part", "n", "sums", "mean", "m2"])

    groups = math.ceil(parts.agg(F.count_distinct("part")).first()[0] / MERGED_AT_ONCE)
    if groups > 1:
        parts = parts.groupBy("dims", F.pmod("part", F.lit(groups)).alias("_group")).applyInPandas(merged, STATE)
    return parts.groupBy("dims").applyInPandas(merged, STATE)


_ARROW = pa.schema(
    [("dims", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))]
)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, the diagonal below it, and the rows of the orthogonal basis (Householder)."""
    a, basis = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        if not (size := np.linalg.norm(v)):
            continue
        v /= size
        a[k + 1 :, k:] -= 2 * v[:, None] * (v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * (a[k:, k + 1 :] @ v)[:, None] * v
        basis[k + 1 :] -= 2 * v[:, None] * (v @ basis[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), basis


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as rows, each with its largest entry
    positive: implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    d, off, basis = tridiagonal(np.asarray(a, float))
    high, eps = len(d) - 1, np.finfo(float).eps
    while high > 0:
        off[:high][np.abs(off[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))] = 0
        if off[high - 1] == 0:
            high -= 1
            continue
        zeros = np.flatnonzero(off[:high] == 0)
        low = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - off[high - 1] ** 2 / (half + math.copysign(math.hypot(half, off[high - 1]), half))
        x, bulge = d[low] - shift, off[low]
        for k in range(low, high):
            r = math.hypot(x, bulge)
            c, s = (x / r, bulge / r) if r else (1.0, 0.0)
            if k > low:
                off[k - 1] = r
            p, q, o = d[k], d[k + 1], off[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * q, s * s * p - 2 * c * s * o + c * c * q
            off[k] = c * s * (q - p) + (c * c - s * s) * o
            if k < high - 1:
                x, bulge = off[k], s * off[k + 1]
                off[k + 1] *= c
            upper = c * basis[k] + s * basis[k + 1]
            basis[k + 1] = c * basis[k + 1] - s * basis[k]
            basis[k] = upper
    order = np.argsort(-d, kind="stable")
    d, basis = d[order], basis[order]
    if len(d):
        basis *= np.where(basis[np.arange(len(d)), np.abs(basis).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return d, basis


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues of the components that are kept
    axes: np.ndarray  # their unit eigenvectors, as rows
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component; NaN where it has no variance."""
        centre = np.array([s / self.n for s in self.sums])
        scale = np.divide(1.0, np.sqrt(self.values), out=np.full(len(self.values), np.nan), where=self.values > 0)
        return (x - centre) @ self.axes.T * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)² in whole numbers, None beyond the range of a long."""
        most = self.n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(1, x.shape[1]) <= LONG_MAX else object
        y = self.n * x.astype(kind) - np.array(self.sums, kind)
        return [int(v) if v <= LONG_MAX else None for v in (y * y).sum(1).tolist()]


def fit(distinct: DataFrame, column: str, components: int) -> dict[int, Fit]:
    """Fits by length of vector, of a stored table of distinct long vectors."""
    states = stored(moments(distinct, column), "merged-moments")
    size = states.agg(F.coalesce(F.sum(F.size("m2")), F.lit(0)) * 8).first()[0]
    if size > STATE_BYTES:
        raise ValueError(f"covariances of {size} bytes are too many for the driver")
    fits = {}
    for row in states.collect():
        m = Moments.of(row)
        values, axes = symmetric_qr(m.m2 / m.n)
        total = float(values.sum())
        some = values > len(values) * np.finfo(float).eps * max(values[:1].max(initial=0), 0)
        values, axes = np.where(some, values, 0.0)[:components], axes[:components]
        fits[row.dims] = Fit(m.n, tuple(m.sums), values, axes, values / total if total > 0 else np.zeros(len(values)))
    # A second pass measures what whitening makes of the list itself.
    back = moments(distinct, column, lambda dims, x: np.nan_to_num(fits[dims].whitened(x)))
    for row in back.collect():
        f, m = fits[row.dims], Moments.of(row)
        k = int((f.values > 0).sum())
        error = float(np.abs(m.m2[:k, :k] / m.n - np.eye(k)).max(initial=0))
        fits[row.dims] = Fit(f.n, f.sums, f.values, f.axes, f.explained, error)
    return fits


def whitened(table: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and its
    first components.

    Rows whose vector is null or has null or non-finite entries are left out; repeated rows
    and null ids keep rows of their own, though equal vectors count once in the fit.  Vectors
    of several lengths are fitted and whitened each among its own length; an empty vector has
    no components.  A component without variance has a null ``whitened``; a deviation beyond
    a long is null.  An empty table gives no rows.  Other columns are not read.
    """
    spark = table.sparkSession
    rows = table.where(usable(vector_col)).select(F.col(id_col).alias("_id"), quantised(vector_col).alias("_x"))
    fits = spark.sparkContext.broadcast(fit(stored(rows.select("_x").distinct(), "vectors"), "_x", components))
    kind = dict(table.dtypes)[id_col]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id")
            for dims, at, x in vectors(batch, "_x"):
                f = fits.value[dims]
                k = len(f.values)
                values = f.whitened(x).ravel()
                n = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(n, f.n, np.int64)),
                        pa.array([v for v in f.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(values, mask=np.isnan(values)),
                        pa.array(np.tile(f.explained, len(at))),
                        pa.array(np.full(n, f.identity_error)),
                    ],
                    names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(project, schema).withColumnRenamed("_id", id_col)
