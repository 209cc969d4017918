"""Powder shells with an amplitude that varies over the sphere: real spherical harmonics fitted to direction cells.

Bins meet shells by their |Q| bucket, never by a condition.  Cell medians come from one combined group-by over all levels of the
cell grid; the robust ridge fit is a grouped map over one shell's few hundred cells; coefficients go back to the bins by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import pseudo_voigt, q_vector
from .filters import measured
from .lattice import BINKEY
from .rings import direction_cell
from .shapes import MAD_TO_SIGMA

#: Cells of cosθ and φ, the finest first; coarser ones are for shells that are measured in few directions.
LEVELS = ((12, 24), (6, 12), (3, 6), (2, 4))
#: Share of a ring's height from which a bin belongs to its core.
CORE = 0.35
ETA = 0.5
_RING = ["volume_id", "ring_id"]


def harmonics(x: np.ndarray, y: np.ndarray, z: np.ndarray, degree: int) -> np.ndarray:
    """Orthonormal real spherical harmonics up to a degree at unit vectors: columns (0,0), (1,−1), (1,0), (1,1), (2,−2) …

    The parts in x, y are the real and imaginary parts of (x + iy)^m; those in z follow the three-term recursion of the
    associated Legendre functions without their sin^m θ.
    """
    n = len(x)
    power = np.ones(n, complex)
    table: dict[tuple[int, int], np.ndarray] = {}
    for m in range(degree + 1):
        odd = math.prod(range(1, 2 * m, 2))  # (2m − 1)!!
        table[m, m] = np.full(n, float((-1) ** m * odd))
        if m < degree:
            table[m + 1, m] = (2 * m + 1) * z * table[m, m]
        for k in range(m + 2, degree + 1):
            table[k, m] = ((2 * k - 1) * z * table[k - 1, m] - (k + m - 1) * table[k - 2, m]) / (k - m)
    powers = [power := power if m == 0 else power * (x + 1j * y) for m in range(degree + 1)]
    out = np.empty((n, (degree + 1) ** 2))
    for k in range(degree + 1):
        for m in range(k + 1):
            norm = math.sqrt((2 * k + 1) / (4 * math.pi) * math.factorial(k - m) / math.factorial(k + m))
            if m == 0:
                out[:, k * k + k] = norm * table[k, 0]
            else:
                out[:, k * k + k + m] = math.sqrt(2) * norm * table[k, m] * powers[m].real
                out[:, k * k + k - m] = math.sqrt(2) * norm * table[k, m] * powers[m].imag
    return out


def degrees_of(terms: int) -> np.ndarray:
    return np.sqrt(np.arange(terms)).astype(int)


def robust_ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their covariance and the residual scale: weighted least squares with a penalty of k(k + 1) on degree k, outliers turned down by 1/|r|.

    A residual counts in full up to 1.5 robust σ of all residuals about their median.
    """
    k = degrees_of(x.shape[1])
    scale = lambda r: max(MAD_TO_SIGMA * float(np.median(np.abs(r - np.median(r)))), 1e-12)
    trust = np.ones(len(y))
    for _ in range(rounds):
        w = weight * trust
        normal = (x * w[:, None]).T @ x
        penalty = ridge * max(np.trace(normal) / len(k), 1e-12) * k * (k + 1.0)
        penalty[0] = max(penalty[0], 1e-12)
        lhs = normal + np.diag(penalty)
        beta = np.linalg.lstsq(lhs, x.T @ (w * y), rcond=None)[0]
        r = y - x @ beta
        trust = 1 / np.maximum(np.abs(r - np.median(r)) / (1.5 * scale(r)), 1.0)
    s = scale(y - x @ beta)
    return beta, np.linalg.pinv(lhs) * s * s, s


def _on_shells(bins: DataFrame, volumes: DataFrame, shells: DataFrame, baseline: DataFrame, step: float) -> DataFrame:
    """Measured bins of each shell's support, with direction, ring profile, and height over the baseline.

    A shell explodes the |Q| buckets of its support; baseline: (volume_id, shell, value), the level at the middle of each
    bucket, read at a bin's own |Q| on the line between two middles.
    """
    s = shells.withColumn("fwhm", F.greatest("fwhm", F.lit(step))).withColumn("_reach", F.greatest(3 * F.col("fwhm"), F.lit(2 * step)))
    s = s.withColumn("_b", F.explode(F.sequence(F.floor((F.col("q0") - F.col("_reach")) / step), F.floor((F.col("q0") + F.col("_reach")) / step))))
    b = bins.filter(measured()).join(volumes.select("volume_id", "ub"), "volume_id").withColumn("_b", F.floor(F.col("q") / step))
    j = b.join(s.select(*_RING, "q0", "fwhm", "height", "_reach", "_b"), ["volume_id", "_b"]).filter((F.abs(F.col("q") - F.col("q0")) <= F.col("_reach")) & (F.col("q") > 0))
    level = baseline.select("volume_id", F.col("shell").cast("long").alias("_s"), F.col("value").alias("_v"))
    left = F.floor(F.col("q") / step - 0.5)
    j = j.withColumn("_s", left).join(level.withColumnRenamed("_v", "_v0"), ["volume_id", "_s"], "left")
    j = j.withColumn("_s", F.col("_s") + 1).join(level.withColumnRenamed("_v", "_v1"), ["volume_id", "_s"], "left")
    t = F.col("q") / step - 0.5 - left
    base = F.coalesce(F.col("_v0") + t * (F.col("_v1") - F.col("_v0")), "_v0", "_v1", F.lit(0.0))
    v = q_vector(F.col("ub"), F.col("h"), F.col("k"), F.col("l"))
    j = j.withColumn("profile", pseudo_voigt(F.col("q"), F.col("q0"), F.col("fwhm"), F.lit(ETA)))
    j = j.withColumn("sample", (F.col("intensity") - base) / F.greatest("profile", F.lit(CORE)))
    return j.select(*_RING, *BINKEY[1:], "q", "height", "profile", "sample", *[(x / F.col("q")).alias(a) for x, a in zip(v, "xyz", strict=True)])


_FIT = (
    "volume_id string, ring_id int, degree int, n_cells int, coverage double, beta array<double>, covariance array<double>, scale double, ceiling double,"
    " residual_rms double"
)


def fit_shells(
    bins: DataFrame, volumes: DataFrame, shells: DataFrame, baseline: DataFrame, step: float, degree: int = 4, ridge: float = 0.08, least: int = 6, levels: Sequence[tuple[int, int]] = LEVELS
) -> DataFrame:
    """Harmonic coefficients of each shell's amplitude (volume_id, ring_id, q0, fwhm, height).

    Cells with ``least`` core bins or more give a median (not under 0) with weight n / noise², capped at the 90th percentile.  The degree falls,
    and for each degree the cells get coarser, until two more cells than terms (and four) are there; a shell without that has
    no row.  ``ceiling`` bounds the amplitude: four heights, or 1.5 times the 95th percentile of the cells.
    """
    core = _on_shells(bins, volumes, shells, baseline, step).filter(F.col("profile") >= CORE)
    cell = F.array(*[F.struct(F.lit(i).alias("level"), direction_cell(F.col("x"), F.col("y"), F.col("z"), F.lit(1.0), n, m).alias("cell")) for i, (n, m) in enumerate(levels)])
    c = core.withColumn("_c", F.explode(cell)).select(*_RING, "height", "_c.level", "_c.cell", "x", "y", "z", "sample")
    key = [*_RING, "level", "cell"]
    med = c.groupBy(*key).agg(F.expr("percentile(sample, 0.5)").alias("median"), F.count("*").alias("n"), F.max("height").alias("height")).filter(F.col("n") >= least)
    spread = c.join(med.select(*key, "median"), key).groupBy(*key).agg(F.expr("percentile(abs(sample - median), 0.5)").alias("mad"))
    mean = _mean_harmonics(c, degree, key)
    cells = med.join(spread, key).join(mean, key)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        for d in range(degree, -1, -1):
            for i, (n, m) in enumerate(levels):
                own = pdf[pdf.level == i].sort_values("cell")
                if len(own) >= max(4, (d + 1) ** 2 + 2):
                    x = np.array(own["mean"].tolist())[:, : (d + 1) ** 2]
                    y = np.maximum(own["median"].to_numpy(float), 0)
                    w = own["n"].to_numpy(float) / np.maximum((MAD_TO_SIGMA * own["mad"].to_numpy(float)) ** 2, 1e-6)
                    beta, cov, scale = robust_ridge(x, y, np.minimum(w, np.percentile(w, 90)), ridge)
                    ceiling = max(4 * float(own["height"].iloc[0]), 1.5 * float(np.percentile(y, 95)), 1e-12)
                    rms = float(np.sqrt(np.mean((np.maximum(x @ beta, 0) - y) ** 2)))
                    row = (pdf.volume_id.iloc[0], pdf.ring_id.iloc[0], d, len(own), len(own) / (n * m), beta.tolist(), cov.ravel().tolist(), scale, ceiling, rms)
                    return pd.DataFrame([row], columns=[f.split()[0] for f in _FIT.split(", ")])
        return pd.DataFrame(columns=[f.split()[0] for f in _FIT.split(", ")])

    return cells.withColumn("ring_id", F.col("ring_id").cast("int")).groupBy(*_RING).applyInPandas(fit, _FIT)


def _mean_harmonics(c: DataFrame, degree: int, key: Sequence[str]) -> DataFrame:
    """Mean of each harmonic over the bins of each cell, as ``mean`` (an array): added up in one combined group-by."""
    terms = (degree + 1) ** 2

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = pd.DataFrame(harmonics(*(b[a].to_numpy(float) for a in "xyz"), degree), columns=[f"y{i}" for i in range(terms)])
            y.insert(0, "n", 1)
            y = pd.concat([b[list(key)].reset_index(drop=True), y], axis=1)
            yield y.groupby(list(key), as_index=False).sum()

    types = {f.name: f.dataType.simpleString() for f in c.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in key] + ["n long"] + [f"y{i} double" for i in range(terms)])
    sums = c.select(*key, "x", "y", "z").mapInPandas(values, schema).groupBy(*key).agg(F.sum("n").alias("_n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(terms)])
    return sums.select(*key, F.array(*[F.col(f"y{i}") / F.col("_n") for i in range(terms)]).alias("mean"))


def shell_model(bins: DataFrame, volumes: DataFrame, shells: DataFrame, fits: DataFrame, baseline: DataFrame, step: float) -> DataFrame:
    """(volume_id, ih, ik, il, mean, variance): the rings' sum at each bin of a fitted shell's support, and its variance."""
    on = _on_shells(bins, volumes, shells, baseline, step).select(*_RING, *BINKEY[1:], "profile", "x", "y", "z")
    j = on.join(fits.select(*_RING, "degree", "beta", "covariance", "scale", "ceiling"), _RING)

    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for (_, _), g in b.groupby(_RING, sort=False):
                r = g.iloc[0]
                y = harmonics(*(g[a].to_numpy(float) for a in "xyz"), int(r.degree))
                cov = np.array(r.covariance).reshape(y.shape[1], -1)
                p = g["profile"].to_numpy(float)
                amplitude = np.clip(y @ np.array(r.beta), 0, r.ceiling)
                variance = np.maximum(((y @ cov) * y).sum(1), 0) + r.scale**2
                parts.append(g[list(BINKEY)].assign(mean=amplitude * p, variance=variance * p * p))
            if parts:
                yield pd.concat(parts)

    types = {f.name: f.dataType.simpleString() for f in j.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in BINKEY) + ", mean double, variance double"
    return j.mapInPandas(model, schema).groupBy(*BINKEY).agg(F.sum("mean").alias("mean"), F.sum("variance").alias("variance"))


def remove_shells(bins: DataFrame, model: DataFrame, policy: str = "conservative", z: float = 1.0) -> DataFrame:
    """bins without the rings: ``intensity`` less the mean less z·σ of the model (never under 0), or the mean itself; σ grows by the model's.

    policy: conservative, mean, or none (the model only widens σ).  ``removed`` is what was taken off.
    """
    if policy not in ("conservative", "mean", "none"):
        raise ValueError(f"unknown policy {policy!r}")
    m, s = F.coalesce("_m", F.lit(0.0)), F.sqrt(F.coalesce("_v", F.lit(0.0)))
    off = {"conservative": F.greatest(m - z * s, F.lit(0.0)), "mean": m, "none": F.lit(0.0)}[policy]
    j = bins.join(model.select(*BINKEY, F.col("mean").alias("_m"), F.col("variance").alias("_v")), BINKEY, "left").withColumn("removed", off)
    j = j.withColumn("intensity", F.col("intensity") - F.col("removed")).withColumn("sigma", F.sqrt(F.col("sigma") ** 2 + F.coalesce("_v", F.lit(0.0))))
    return j.drop("_m", "_v")
