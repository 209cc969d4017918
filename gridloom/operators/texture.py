"""Powder rings that share one azimuthal texture: amplitudes of rings by patches, their rank-one factors, and the rings' removal.

Bins meet rings by |Q| bucket and patches by their own azimuth; trimmed means come from two combined group-bys; the factors of the small
matrix of a volume are found by alternating weighted sums in a grouped map over its few cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import azimuth, q_vector
from .filters import measured
from .lattice import BINKEY

TWO_PI = 2 * math.pi
#: Share of a ring's model by which σ grows.
SIGMA_SHARE = 0.1
_CELL = ["volume_id", "ring_id", "patch"]


def _on_rings(bins: DataFrame, volumes: DataFrame, rings: DataFrame, reach: float) -> DataFrame:
    """Measured bins within reach of a ring (volume_id, ring_id, q0), with the azimuth phi about the third axis of Q."""
    r = rings.select("volume_id", "ring_id", "q0").withColumn("_b", F.explode(F.sequence(F.floor((F.col("q0") - reach) / reach), F.floor((F.col("q0") + reach) / reach))))
    b = bins.filter(measured()).withColumn("_b", F.floor(F.col("q") / reach)).join(volumes.select("volume_id", "ub"), "volume_id")
    x, y, _ = q_vector(F.col("ub"), F.col("h"), F.col("k"), F.col("l"))
    j = b.withColumn("phi", azimuth(x, y)).join(r, ["volume_id", "_b"]).filter(F.abs(F.col("q") - F.col("q0")) <= reach)
    return j.select("volume_id", "ring_id", "q0", *BINKEY[1:], "q", "phi", "intensity", "sigma")


def patch_amplitudes(
    bins: DataFrame, volumes: DataFrame, rings: DataFrame, patches: int = 24, half: float = 0.08, flank: float = 0.2, overlap: float = 0.25, trim: tuple[float, float] = (0.2, 0.8), least: int = 5
) -> DataFrame:
    """(volume_id, ring_id, patch, amplitude, spread, n): trimmed mean of each ring's shell in each azimuthal patch, over that of its flanks.

    A patch also takes ``overlap`` of its width from both neighbours.  Values between the ``trim`` percentiles of a patch's shell (and of its flanks) are
    averaged, so gaps and sharp peaks count for nothing; patches with under ``least`` values in either have no row.
    """
    if not 0 <= overlap <= 0.5:
        raise ValueError("an overlap is between 0 and half a patch")
    w = TWO_PI / patches
    j = _on_rings(bins, volumes, rings, flank).withColumn("shell", F.abs(F.col("q") - F.col("q0")) <= half)
    near = F.floor(F.col("phi") / w + 0.5)
    j = j.withColumn("_p", F.explode(F.array(near - 1, near, near + 1))).filter(F.abs(F.col("phi") - F.col("_p") * w) <= (0.5 + overlap) * w)
    j = j.select("volume_id", "ring_id", F.pmod(F.col("_p"), F.lit(patches)).cast("int").alias("patch"), "shell", "intensity")
    key = [*_CELL, "shell"]
    ends = j.groupBy(*key).agg(F.expr(f"percentile(intensity, array({trim[0]}, {trim[1]}))").alias("_e"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    kept = j.join(ends, key).filter(F.col("intensity").between(F.col("_e")[0], F.col("_e")[1]))
    m = kept.groupBy(*key).agg(F.avg("intensity").alias("m"), F.stddev_pop("intensity").alias("s"), F.max("_n").alias("n"))
    side = lambda c, on: F.max(F.when(F.col("shell") == on, F.col(c)))
    g = m.groupBy(*_CELL).agg(side("m", True).alias("_ring"), side("m", False).alias("_base"), side("s", True).alias("spread"), side("n", True).alias("n"))
    return g.filter("_ring is not null and _base is not null").select(*_CELL, (F.col("_ring") - F.col("_base")).alias("amplitude"), "spread", "n")


def rank_one(values: np.ndarray, known: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) whose product is nearest the known values: each in turn the weighted sum over the other, until neither moves.

    With all values known these are the first singular pair.  The columns' mean is 1 (unless it is 0); nothing known gives zeros.
    """
    w = known.astype(float)
    v = np.where(known, values, 0.0)
    columns = np.where(w.any(0), 1.0, 0.0)
    rows = np.zeros(len(v))
    for _ in range(rounds):
        below = w @ columns**2
        rows = np.divide(v @ columns, below, out=np.zeros_like(rows), where=below > 0)
        below = rows**2 @ w
        new = np.divide(rows @ v, below, out=np.zeros_like(columns), where=below > 0)
        size = np.linalg.norm(new)
        if size == 0:
            return rows * 0, columns * 0
        moved = np.abs(new / size - columns / max(np.linalg.norm(columns), 1e-300)).max()
        columns = new / size
        rows = rows * size
        if moved < 1e-13:
            break
    mean = columns[w.any(0)].mean()
    return (rows * mean, columns / mean) if mean else (rows, columns)


_FACTORS = "volume_id string, n_rings int, n_patches int, share double, rings array<int>, amplitudes array<double>, patches array<int>, texture array<double>, fourier array<double>"


def factored_rings(amplitudes: DataFrame, patches: int = 24, harmonics: int = 6) -> DataFrame:
    """One row a volume: ring amplitudes and the one texture they share (mean 1), and the texture's Fourier coefficients (1, cos φ, sin φ, cos 2φ …).

    ``share`` is the part of the squared amplitudes that the factors explain; well under 1 the rings differ in texture.  As many harmonics are fitted as the
    patches allow.  A grouped map over the cells of one volume, rings × patches at most.
    """

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        rings, patch = np.sort(pdf.ring_id.unique()), np.sort(pdf.patch.unique())
        v, known = np.zeros((len(rings), len(patch))), np.zeros((len(rings), len(patch)), bool)
        at = np.searchsorted(rings, pdf.ring_id), np.searchsorted(patch, pdf.patch)
        v[at], known[at] = pdf.amplitude, True
        a, t = rank_one(v, known)
        total = (v[known] ** 2).sum()
        share = 1 - ((v - np.outer(a, t))[known] ** 2).sum() / total if total > 0 else None
        phi, m = patch * TWO_PI / patches, min(harmonics, (len(patch) - 1) // 2)
        basis = np.column_stack([np.ones(len(phi)), *[f(k * phi) for k in range(1, m + 1) for f in (np.cos, np.sin)]])
        c = np.linalg.lstsq(basis, t, rcond=None)[0]
        row = (pdf.volume_id.iloc[0], len(rings), len(patch), share, rings.tolist(), a.tolist(), patch.tolist(), t.tolist(), c.tolist())
        return pd.DataFrame([row], columns=[x.split()[0] for x in _FACTORS.split(", ")])

    return amplitudes.groupBy("volume_id").applyInPandas(factor, _FACTORS)


def _texture(phi: Column, c: Column) -> Column:
    """The Fourier series of coefficients c at an angle."""
    terms = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.size(c) - 1) / 2).cast("int"))), lambda k: F.coalesce(F.get(c, 2 * k - 1), F.lit(0.0)) * F.cos(k * phi) + F.coalesce(F.get(c, 2 * k), F.lit(0.0)) * F.sin(k * phi))
    return c[0] + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def remove_factored(bins: DataFrame, volumes: DataFrame, rings: DataFrame, factors: DataFrame, half: float = 0.08, limit: float | None = None) -> DataFrame:
    """bins without the rings: each a Gaussian of σ half/2 in |Q| times its amplitude and the shared texture; ``removed`` is what was taken off.

    σ grows by a tenth of what was taken; with a ``limit``, bins where it exceeds that many σ are no longer measured.
    """
    f = factors.select("volume_id", "fourier", F.explode(F.arrays_zip("rings", "amplitudes")).alias("_r")).select("volume_id", "fourier", F.col("_r.rings").alias("ring_id"), F.col("_r.amplitudes").alias("_a"))
    on = _on_rings(bins, volumes, rings, 3 * half).join(f, ["volume_id", "ring_id"])
    part = F.col("_a") * _texture(F.col("phi"), F.col("fourier")) * F.exp(-0.5 * F.pow((F.col("q") - F.col("q0")) / (half / 2), F.lit(2.0)))
    model = on.withColumn("_m", part).groupBy(*BINKEY).agg(F.sum("_m").alias("_m"))
    j = bins.join(model, BINKEY, "left").withColumn("removed", F.coalesce("_m", F.lit(0.0)))
    too_much = F.lit(False) if limit is None else F.coalesce((F.col("sigma") > 0) & (F.col("removed") / F.col("sigma") >= limit), F.lit(False))
    j = j.withColumn("measured", F.col("measured") & ~too_much)
    return j.withColumn("intensity", F.col("intensity") - F.col("removed")).withColumn("sigma", F.sqrt(F.col("sigma") ** 2 + (SIGMA_SHARE * F.col("removed")) ** 2)).drop("_m")
