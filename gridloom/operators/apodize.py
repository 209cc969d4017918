"""An ellipsoidal window with the symmetry of the lattice, shrunk until it keeps off the space that was never measured.

The operations of a lattice are sought among integer matrices made on each volume's row; bins meet their window's
quadratic form by volume; the weight on open space comes from counts of bins by their distance, so any scale is tried on a few thousand
counts and not on the bins again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import quadratic
from .cells import metric_of
from .filters import measured
from .lattice import BINKEY, components, grid, saved, unmeasured

#: Largest change of the metric (relative to its diagonal) under an operation of the lattice.
METRIC_LIMIT = 0.05
#: Counts of distance from the centre to the far corner, and steps of the scale.
RHO_BINS, SCALES = 4096, 1000


def with_operations(volumes: DataFrame) -> DataFrame:
    """volumes with a row for each integer matrix ``op`` of entries −1, 0, 1 and determinant ±1: what symmetry conventional and reduced cells can have.

    The 19,683 candidates are the numbers of nine digits to base 3, made on each volume's own row.
    """
    v = volumes.withColumn("_i", F.explode(F.expr(f"sequence(0, {3**9 - 1})")))
    v = v.withColumn("op", F.array(*[F.expr(f"cast(_i div {3**k} % 3 - 1 as int)") for k in range(9)])).drop("_i")
    a, b, c, d, e, f, g, h, i = (F.col("op")[k] for k in range(9))
    return v.filter(F.abs(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)) == 1)


def lattice_group(volumes: DataFrame, limit: float = METRIC_LIMIT) -> DataFrame:
    """(volume_id, ops): the operations R of (h, k, l) under which RᵀGR = G for the metric G = UBᵀUB, to a limit of √(G_ii·G_jj).

    Axes of one plane take no part: operations that move them are left out.  Only ±1 for a singular UB.
    """
    j = with_operations(volumes.select("volume_id", "nh", "nk", "nl", F.array(*metric_of(F.col("ub"))).alias("g")))
    op, g = F.col("op"), F.col("g")
    moved = {(r, c): sum((op[3 * i + r] * g[3 * i + k] * op[3 * k + c] for i in range(3) for k in range(3)), F.lit(0.0)) for r in range(3) for c in range(r, 3)}
    sound = F.least(g[0], g[4], g[8]) > 0
    change = F.greatest(*[F.abs(x - g[3 * r + c]) / F.sqrt(g[4 * r] * g[4 * c]) for (r, c), x in moved.items()])
    apart = F.lit(True)
    for i, a in enumerate("hkl"):
        others = [x for x in range(3) if x != i]
        still = F.lit(True)
        for o in others:
            still = still & (op[3 * i + o] == 0) & (op[3 * o + i] == 0)
        apart = apart & ((F.col(f"n{a}") > 1) | still)
    one = F.array(*[F.lit(int(i % 4 == 0)) for i in range(9)])
    minus = F.array(*[F.lit(-int(i % 4 == 0)) for i in range(9)])
    keep = F.when(sound, change <= limit).otherwise((op == one) | (op == minus))
    return j.filter(keep & apart).groupBy("volume_id").agg(F.sort_array(F.collect_list("op")).alias("ops"))  # 48 at most


def invariant_form(ops: np.ndarray, half: np.ndarray) -> np.ndarray:
    """M of the largest ellipsoid xᵀMx ≤ 1 in the box |x_i| ≤ half_i that all ops map onto itself.

    The best M is a positive combination of the box's faces, each averaged over the group; the weights are those of a
    D-optimal design and are found by multiplying each with its face's share until none moves.  The form is then scaled to touch
    the nearest face.
    """
    rows = ops.astype(float)
    faces = np.einsum("gij,gik->ijk", rows, rows) / len(rows) / (half**2)[:, None, None]
    weight = np.ones(len(half))
    for _ in range(1000):
        moved = weight * np.einsum("ijk,kj->i", faces, np.linalg.inv(np.einsum("i,ijk->jk", weight, faces)))
        still = np.abs(moved - weight).max() < 1e-13
        weight = moved
        if still:
            break
    form = np.einsum("i,ijk->jk", weight, faces)
    form = form * (np.diag(np.linalg.inv(form)) / half**2).max()
    return (form + form.T) / 2


def ellipsoids(volumes: DataFrame, limit: float = METRIC_LIMIT) -> DataFrame:
    """(volume_id, n_ops, form): the invariant ellipsoid about Q = 0 in each volume's box; null where 0 is not inside the box."""

    def make(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                active = [i for i, n in enumerate((r.nh, r.nk, r.nl)) if n > 1]
                half = np.array([min(-x0, x0 + (n - 1) * d) for x0, d, n in ((r.h0, r.dh, r.nh), (r.k0, r.dk, r.nk), (r.l0, r.dl, r.nl))])[active]
                ops = np.array([list(o) for o in r.ops], float).reshape(-1, 3, 3)[:, active][:, :, active]
                form = None
                if active and (half > 0).all():
                    whole = np.zeros((3, 3))
                    whole[np.ix_(active, active)] = invariant_form(ops, half)
                    form = whole.ravel().tolist()
                rows.append((r.volume_id, len(r.ops), form))
            yield pd.DataFrame(rows, columns=["volume_id", "n_ops", "form"])

    v = volumes.join(lattice_group(volumes, limit), "volume_id")
    cols = ["volume_id", *[f"{x}{a}" for a in "hkl" for x in ("n", "d")], *[f"{a}0" for a in "hkl"], "ops"]
    return v.select(*cols).mapInPandas(make, "volume_id string, n_ops int, form array<double>")


def taper(kind: str, rho: Column, sigma: float = 0.4) -> Column:
    """Weight at a distance: 1 at 0, 0 from 1 on."""
    inside = {
        "none": F.lit(1.0),
        "hann": 0.5 * (1 + F.cos(math.pi * rho)),
        "gaussian": (F.exp(-0.5 * F.pow(rho / sigma, F.lit(2.0))) - math.exp(-0.5 / sigma**2)) / (1 - math.exp(-0.5 / sigma**2)),
    }[kind]
    return F.when(rho < 1, inside).otherwise(0.0)


def _taper(kind: str, rho: np.ndarray, sigma: float) -> np.ndarray:
    edge = math.exp(-0.5 / sigma**2)
    inside = {"none": np.ones_like(rho), "hann": 0.5 * (1 + np.cos(np.pi * rho)), "gaussian": (np.exp(-0.5 * (rho / sigma) ** 2) - edge) / (1 - edge)}[kind]
    return np.where(rho < 1, inside, 0.0)


def open_space(bins: DataFrame, volumes: DataFrame) -> DataFrame:
    """Unmeasured bins whose region (corners included) reaches a face of the box: where the coverage ends.  Axes of one plane have no faces."""
    u = saved(unmeasured(bins, volumes))
    face = F.greatest(*[F.when((F.col(f"n{a}") > 1) & ((F.col(f"i{a}") == 0) | (F.col(f"i{a}") == F.col(f"n{a}") - 1)), 1).otherwise(0) for a in "hkl"])
    r = saved(components(u, faces=False).join(u.select(*BINKEY, face.alias("_f")), BINKEY))
    touching = r.groupBy("volume_id", "region").agg(F.max("_f").alias("_t")).filter("_t = 1")
    return r.join(touching, ["volume_id", "region"], "left_semi").select(*BINKEY)


def _rho(form: str = "form") -> Column:
    x = [F.col(f"{a}0") + F.col(f"i{a}") * F.col(f"d{a}") for a in "hkl"]
    return F.sqrt(F.greatest(quadratic([F.col(form)[i] for i in range(9)], *x), F.lit(0.0)))


def fitted_windows(bins: DataFrame, volumes: DataFrame, kind: str = "gaussian", sigma: float = 0.4, tolerance: float = 1e-3, limit: float = METRIC_LIMIT) -> DataFrame:
    """(volume_id, n_ops, form, scale, open_weight): each volume's invariant ellipsoid, scaled so that its weight on open space is within tolerance.

    The scale is the largest of a thousand steps that meets the tolerance; with a tolerance of 0 it ends at the nearest open bin.
    ``form`` is that of the scaled ellipsoid, and null with scale 0 where no scale does.  Bins are read once, for counts of their distance.
    """
    e = saved(ellipsoids(volumes, limit))
    v = volumes.join(e, "volume_id").filter("form is not null")
    corner = [quadratic([F.col("form")[i] for i in range(9)], *[F.col(f"{a}0") + (F.col(f"n{a}") - 1) * F.col(f"d{a}") * s for a, s in zip("hkl", c, strict=True)]) for c in np.ndindex(2, 2, 2)]
    v = v.withColumn("_top", F.sqrt(F.greatest(F.lit(1.0), *corner)) * (1 + 1e-9))
    cols = ["volume_id", *[f"{a}0" for a in "hkl"], *[f"d{a}" for a in "hkl"], "form", "_top"]
    is_open = open_space(bins, volumes).withColumn("_o", F.lit(1))
    g = grid(v).join(is_open, BINKEY, "left").join(v.select(*cols), "volume_id").withColumn("_rho", _rho())
    b = F.least(F.floor(F.col("_rho") * RHO_BINS / F.col("_top")), F.lit(RHO_BINS - 1)).cast("int")
    counts = g.groupBy("volume_id", b.alias("b")).agg(F.count("*").alias("n"), F.count("_o").alias("n_open"), F.min(F.when(F.col("_o") == 1, F.col("_rho"))).alias("nearest"), F.max("_top").alias("top"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = (pdf.b.to_numpy() + 0.5) * (pdf.top.iloc[0] / RHO_BINS)
        n, n_open, nearest = pdf.n.to_numpy(float), pdf.n_open.to_numpy(float), pdf.nearest.min()
        if n_open.sum() == 0:
            return pd.DataFrame([(pdf.volume_id.iloc[0], 1.0, 0.0)], columns=["volume_id", "scale", "open_weight"])
        if tolerance <= 0:
            return pd.DataFrame([(pdf.volume_id.iloc[0], float(min(1.0, nearest)), 0.0)], columns=["volume_id", "scale", "open_weight"])
        for step in range(SCALES, 0, -1):
            w = _taper(kind, rho * SCALES / step, sigma)
            total, on = w @ n, w @ n_open
            if total > 0 and on <= tolerance * total:
                return pd.DataFrame([(pdf.volume_id.iloc[0], step / SCALES, on / total)], columns=["volume_id", "scale", "open_weight"])
        return pd.DataFrame([(pdf.volume_id.iloc[0], 0.0, None)], columns=["volume_id", "scale", "open_weight"])

    s = counts.groupBy("volume_id").applyInPandas(fit, "volume_id string, scale double, open_weight double")
    form = F.when(F.col("scale") > 0, F.transform("form", lambda x: x / F.col("scale") ** 2))
    return e.join(s, "volume_id", "left").select("volume_id", "n_ops", form.alias("form"), "scale", "open_weight")


def windowed(bins: DataFrame, volumes: DataFrame, windows: DataFrame, kind: str = "gaussian", sigma: float = 0.4) -> DataFrame:
    """Measured bins inside each volume's window: (volume_id, ih, ik, il, value, weight, mean), the weighted mean taken off and the weight applied.

    The same columns as :func:`gridloom.operators.transform.prepared`, so the transform takes either.
    """
    cols = ["volume_id", *[f"{a}0" for a in "hkl"], *[f"d{a}" for a in "hkl"]]
    w = volumes.select(*cols).join(windows.filter("form is not null").select("volume_id", "form"), "volume_id")
    b = bins.filter(measured()).select(*BINKEY, "intensity").join(w, "volume_id").withColumn("weight", taper(kind, _rho(), sigma)).filter("weight > 0")
    b = b.select(*BINKEY, "intensity", "weight")
    mean = b.groupBy("volume_id").agg((F.sum(F.col("weight") * F.col("intensity")) / F.sum("weight")).alias("mean"))
    return b.join(mean, "volume_id").select(*BINKEY, ((F.col("intensity") - F.col("mean")) * F.col("weight")).alias("value"), "weight", "mean")


def weight_on(volumes: DataFrame, windows: DataFrame, region: DataFrame, kind: str = "gaussian", sigma: float = 0.4) -> DataFrame:
    """(volume_id, share): how much of each window's weight over the whole grid lies on the bins of region; read bin by bin, to check a fit."""
    cols = ["volume_id", *[f"{a}0" for a in "hkl"], *[f"d{a}" for a in "hkl"]]
    w = volumes.select(*cols).join(windows.filter("form is not null").select("volume_id", "form"), "volume_id")
    g = grid(volumes).join(region.select(*BINKEY).withColumn("_o", F.lit(1)), BINKEY, "left").join(w, "volume_id").withColumn("_w", taper(kind, _rho(), sigma))
    return g.groupBy("volume_id").agg((F.sum(F.when(F.col("_o") == 1, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("share"))
