"""Embedding whitening by incremental eigendecomposition (operator 13).

Each partition starts from nothing and takes its distinct vectors one by one: a vector changes the scatter matrix by one
centred rank-one term, and the eigenvalues move to the roots of a secular equation, after deflation of equal
eigenvalues and of directions that the vector doesn't touch.  Spectra of partitions are combined in a tree, each by
successive rank-one updates with the eigenpairs of the other and with the shift of the means.  The basis so found goes
back to all partitions for one Rayleigh-Ritz step: the covariance of the vectors projected on it, centred with the exact
sums of whole numbers, whose small eigenproblem gives the components to double precision.

A task holds one matrix of the dimension squared, whatever it reads; matrices meet ``FAN_IN`` at a time in a tree.  Dimensions
over ``MOST_DIMENSIONS`` are refused.

Defined results: rows whose vector is null, or holds null or a value that is not finite, are left out; vectors of another
length than the most frequent one (the longest of several) have no place in the covariance and are left out too;
repeated vectors count once in the fit and each row is returned; components with an eigenvalue under ``RANK`` times the largest are
noise of the arithmetic and are left out, so fewer distinct vectors than dimensions give fewer components, and one gives
none; an empty table gives an empty result; a deviation beyond 63 bits is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import materialise

#: Components returned.
COMPONENTS = 16
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Partitions' matrices that meet in one task of the tree.
FAN_IN = 32
#: Vectors in a partition of a large table.
PART_ROWS = 25_000
#: A matrix of so many rows and columns takes 32 MB; it is sent to all executors.
MOST_DIMENSIONS = 2048
#: Least eigenvalue of a component, as a share of the largest.
RANK = 1e-10

EPS = np.finfo(float).eps


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z' for rho > 0, d rising and distinct, z without zeros.

    All roots are sought at once, each as its distance from the pole next to it; steps interpolate by the two poles
    around a root and fall back to the bracket.  Vectors come from the z that has these roots exactly, so they are orthogonal.
    """
    k, z2 = len(d), z * z
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    half = (upper - d) / 2
    with np.errstate(all="ignore"):
        left = 1 + rho * (z2 / (d - (d + half)[:, None])).sum(1) >= 0
        near_low = left.copy()
        near_low[-1] = True
        origin = np.where(near_low, d, upper)
        poles, top = d - origin[:, None], upper - origin
        lo = np.where(left, 0.0, np.where(near_low, half, -half))
        hi = np.where(left, half, np.where(near_low, 2 * half, 0.0))
        below, own = np.tri(k), np.diag(poles).copy()
        t = (lo + hi) / 2
        for _ in range(100):
            gap = poles - t[:, None]
            r = z2 / gap
            slope = rho * r / gap
            f, steep = 1 + rho * r.sum(1), slope.sum(1)
            # what the rounding of the sum and of the root's own place leave
            done = np.abs(f) <= 4 * EPS * (k + rho * np.abs(r).sum(1) + np.abs(t) * steep)
            if done.all():
                break
            psi = np.einsum("ij,ij->i", slope, below)
            phi = steep - psi
            lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
            d0, d1 = own - t, top - t
            a, b, c = (d0 + d1) * f - d0 * d1 * steep, d0 * d1 * f, f - d0 * psi - d1 * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = t + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            inside = np.where(lo == 0, hi / 10, np.where(hi == 0, lo / 10, (lo + hi) / 2))
            t = np.where(done | (new == t), t, np.where((new > lo) & (new < hi), new, inside))
        away = t[:, None] - poles  # root j less pole i
        between = d[:, None] - d
        np.fill_diagonal(between, 1.0)
        zs = np.copysign(np.sqrt((away / between).prod(0) / rho), z)
        u = -zs[:, None] / away.T
    return origin + t, u / np.sqrt((u * u).sum(0))


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of q diag(d) q' + rho v v'."""
    z = v @ q
    size = z @ z
    if rho * size <= 0:
        return d, q
    z, rho = z / np.sqrt(size), rho * size
    least = 8 * EPS * max(np.abs(d).max(), rho)
    cuts = np.flatnonzero(np.diff(d) > least) + 1
    if len(cuts) + 1 < len(d):  # equal eigenvalues: turn their vectors so that one of them takes all of z
        q = q.copy()
        for s, e in zip([0, *cuts], [*cuts, len(d)]):
            part = np.linalg.norm(z[s:e]) if e - s > 1 else 0
            if part > 0:
                u = z[s:e].copy()
                u[-1] += np.copysign(part, u[-1])
                q[:, s:e] -= np.outer(q[:, s:e] @ u, u * (2 / (u @ u)))
                z[s:e], z[e - 1] = 0, -np.copysign(part, z[e - 1])
    touched = np.flatnonzero(rho * np.abs(z) > least)
    if not len(touched):
        return d, q
    d, u = d.copy(), secular(d[touched], z[touched], rho)
    d[touched] = u[0]
    turned = q.copy()
    turned[:, touched] = q[:, touched] @ u[1]
    order = np.argsort(d, kind="stable")
    return d[order], turned[:, order]


class Spectrum:
    """Eigenpairs of the scatter matrix of the vectors taken so far, with their number and exact sums."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, np.zeros(dims, np.int64)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def mean(self) -> np.ndarray:
        return (self.sums - self.n * OFFSET) / max(self.n, 1)

    def take(self, x: np.ndarray) -> None:
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, x - OFFSET - self.mean(), self.n / (self.n + 1))
        self.n, self.sums = self.n + 1, self.sums + x

    def combine(self, o: Spectrum) -> None:
        if self.n and o.n:
            shift = self.mean() - o.mean()
            for value, vector in [*zip(o.values, o.vectors.T), (self.n * o.n / (self.n + o.n), shift)]:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        elif o.n:
            self.values, self.vectors = o.values, o.vectors
        self.n, self.sums = self.n + o.n, self.sums + o.sums


def vectors(df: DataFrame, name: str = "embedding") -> tuple[DataFrame, int, int]:
    """df's vec_id and x, whole numbers, of the rows that have all entries; the dimension and the number of rows."""
    e = F.col(name)
    finite = F.forall(e, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    x = F.transform(e, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(OFFSET))
    df = df.filter(e.isNotNull()).filter(finite)
    lengths = df.groupBy(F.size(e).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims, n = (lengths.d, lengths.n) if lengths else (0, 0)
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dims} entries; at most {MOST_DIMENSIONS} are taken")
    return df.filter(F.size(e) == dims).select("vec_id", x.alias("x")), dims, n


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def _tree(df: DataFrame, parts: int, combine: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """One row of many: rows of partitions (part, ...) meet FAN_IN at a time."""
    df = df.withColumn("part", F.spark_partition_id())
    while True:
        df = df.withColumn("part", F.expr(f"cast(part div {FAN_IN} as int)"))
        df = df.groupBy("part").applyInPandas(lambda g: combine(g.sort_values("part")), df.schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return df


_SPECTRA = "n long, sums array<long>, vals array<double>, vecs array<double>"


def _as_row(s: Spectrum) -> dict:
    return {"n": [s.n], "sums": [s.sums.tolist()], "vals": [s.values.tolist()], "vecs": [s.vectors.ravel().tolist()]}


def spectrum(fit: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all x of fit (distinct): rank-one updates in the partitions, combined in a tree."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(dims)
        for b in batches:
            for x in _rows(b, dims):
                s.take(x)
        if s.n:
            yield pa.RecordBatch.from_pydict(_as_row(s))

    def read(r) -> Spectrum:
        s = Spectrum(dims)
        s.n, s.sums = int(r.n), np.array(r.sums, np.int64)
        s.values, s.vectors = np.array(r.vals, float), np.array(r.vecs, float).reshape(dims, dims)
        return s

    def combine(g: pd.DataFrame) -> pd.DataFrame:
        s = Spectrum(dims)
        for r in g.itertuples():
            s.combine(read(r))
        return pd.DataFrame(_as_row(s) | {"part": [int(g.part.iloc[0])]})

    one = _tree(fit.mapInArrow(of_partition, _SPECTRA), fit.rdd.getNumPartitions(), combine).first()
    return read(one) if one else Spectrum(dims)


def _product(fit: DataFrame, dims: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of fit's vectors, centred by the exact sums, projected on basis."""
    shared = fit.sparkSession.sparkContext.broadcast((sums, basis))
    k = basis.shape[1]

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (sums, basis), total = shared.value, np.zeros((k, k))
        for b in batches:
            y = ((n * _rows(b, dims) - sums) / n) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"m": [total.ravel().tolist()]})

    def combine(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [np.sum([np.asarray(m) for m in g.m], axis=0)], "part": [int(g.part.iloc[0])]})

    one = _tree(fit.mapInArrow(of_partition, "m array<double>"), fit.rdd.getNumPartitions(), combine).first()
    return np.array(one.m, float).reshape(k, k) / n


def refined(fit: DataFrame, s: Spectrum) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling eigenvalues, unit eigenvectors and the trace: a Rayleigh-Ritz step over all vectors on the basis of s."""
    basis = np.linalg.qr(s.vectors[:, ::-1])[0]
    small = _product(fit, len(basis), s.n, s.sums, basis)
    e, u = np.linalg.eigh((small + small.T) / 2)
    return e[::-1], basis @ u[:, ::-1], float(np.trace(small))


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    schema = StructType(
        [df.schema["vec_id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType())]
        + [StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    rows, dims, n_rows = vectors(df)
    # an update costs far more than moving its vector, so the few distinct vectors of a small table are dealt to all cores
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // PART_ROWS))
    fit = materialise(rows.select("x").distinct().repartition(parts)) if dims else None
    s = spectrum(fit, dims) if dims else Spectrum(1)
    if s.n < 2:
        return df.sparkSession.createDataFrame([], schema)
    e, q, trace = refined(fit, s)
    k = int((e[:components] > RANK * e[0]).sum())
    e, q = e[:k], q[:, :k]
    identity = _product(fit, dims, s.n, s.sums, q / np.sqrt(e)) - np.eye(k)
    error, explained, n, sums, arrow = float(np.abs(identity).max()), e / trace, s.n, s.sums, to_arrow_schema(schema)
    shared = df.sparkSession.sparkContext.broadcast((sums, q / np.sqrt(e)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, axes = shared.value
        for b in batches:
            away = n * _rows(b, dims) - sums
            fits = (away.astype(float) ** 2).sum(1) < 2.0**63 * (1 - 1e-9)
            squares = (np.where(fits[:, None], away, 0) ** 2).sum(1)
            m = len(away)
            columns = [
                b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n),
                pa.array(np.repeat(squares, k), mask=np.repeat(~fits, k)), ((away / n) @ axes).ravel(), np.tile(explained, m), np.full(m * k, error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=arrow)

    return rows.mapInArrow(project, schema)
