"""Measured peak centres at the nodes of a lattice, and the orientation refined with them, from low |Q| outward."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.geometry import q_vector
from .cells import ub_fit
from .lattice import saved
from .shapes import _VOLUME, MAD_TO_SIGMA, _box, _half

#: σ of the centring window, in bins.
WINDOW_BINS = 1.5
_NODE = "volume_id string, nh int, nk int, nl int, peak_id long, ch double, ck double, cl double, excess double, significance double, status string"


def predicted_nodes(volumes: DataFrame, cell: Sequence[int] = (1, 1, 1), window: float = WINDOW_BINS) -> DataFrame:
    """Nodes of each volume with where its ``ub_now`` (its own UB without one) puts them: ch, ck, cl in the volume's h, k, l, and |Q| as q.

    ``width`` is the centring window (Å⁻¹) and ``per`` the bins along each axis that 1 Å⁻¹ reaches.  Candidates are the multiples of cell in the
    bounding box of the grid's corners; each volume's list is made from its own row.
    """
    now = F.coalesce(F.col("ub_now"), F.col("ub")) if "ub_now" in volumes.columns else F.col("ub")
    v = volumes.select("volume_id", *_VOLUME, now.alias("now"))

    def nodes(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                ub, ahead = np.array(r.ub, float).reshape(3, 3), np.array(r.now, float).reshape(3, 3)
                if not np.isfinite(ahead).all() or np.linalg.cond(ahead) > 1e8:
                    ahead = ub  # a fit to nodes of one plane predicts nothing
                start, step, n = np.array([r.h0, r.k0, r.l0]), np.array([r.dh, r.dk, r.dl]), np.array([r.nh, r.nk, r.nl])
                corners = np.array([start + (n - 1) * step * c for c in np.ndindex(2, 2, 2)]) @ ub.T @ np.linalg.inv(ahead).T
                lo, hi = np.ceil(corners.min(0) / cell - 1e-9).astype(int), np.floor(corners.max(0) / cell + 1e-9).astype(int)
                g = np.stack(np.meshgrid(*[np.arange(x, y + 1) for x, y in zip(lo, hi, strict=True)], indexing="ij"), -1).reshape(-1, 3) * np.array(cell)
                q = g @ ahead.T
                at = q @ np.linalg.inv(ub).T
                out = pd.DataFrame(np.column_stack([at, np.linalg.norm(q, axis=1)]), columns=["ch", "ck", "cl", "q"])
                for i, a in enumerate("hkl"):
                    out[f"g{a}"] = g[:, i].astype(np.int32)
                for c in ("volume_id", *[f"{x}{a}" for a in "hkl" for x in ("n", "d")], *[f"{a}0" for a in "hkl"]):
                    out[c] = getattr(r, c)
                out["ub"] = [list(r.ub)] * len(out)
                out["width"] = window * abs(np.linalg.det(ub) * np.prod(step)) ** (1 / 3)
                out["per"] = [(np.linalg.norm(np.linalg.inv(ub), axis=1) / np.abs(step)).tolist()] * len(out)
                yield out[out["q"] > 0]

    own = [v.schema[c] for c in ("volume_id", *_VOLUME)]
    made = [StructField(c, DoubleType()) for c in ("ch", "ck", "cl", "q", "width")] + [StructField(f"g{a}", IntegerType()) for a in "hkl"]
    schema = StructType([*own, *made, StructField("per", ArrayType(DoubleType()))])
    return v.mapInPandas(nodes, schema).withColumn("peak_id", F.xxhash64("gh", "gk", "gl"))


def windowed_centre(q: np.ndarray, excess: np.ndarray, start: np.ndarray, width: float, reach: float) -> np.ndarray | None:
    """Where the centroid of excess under a Gaussian window about itself stays: at most 100 moves from start.

    The window is cut at three of its σ.  None if its weight is not positive, the centre leaves ``reach``, or does not settle.
    """
    at = start.astype(float)
    for _ in range(100):
        d = q - at
        r2 = np.einsum("ij,ij->i", d, d)
        w = np.where(r2 <= 9 * width * width, excess * np.exp(-r2 / (2 * width * width)), 0.0)
        total = w.sum()
        if not total > 0:
            return None
        move = w @ d / total
        at = at + move
        if np.linalg.norm(at - start) > reach:
            return None
        if np.linalg.norm(move) < 1e-6 * width:
            return at
    return None


def measured_centres(
    bins: DataFrame, volumes: DataFrame, reach: float = 0.25, least: float = 10.0, cell: Sequence[int] = (1, 1, 1), q_min: float = 0.0, q_max: float | None = None, least_shell: int = 7,
    window: float = WINDOW_BINS,
) -> DataFrame:
    """The peak of each node and its centre (r.l.u. of the volume): (volume_id, nh, nk, nl, ch, ck, cl, excess, significance, status).

    A node's peak is the brightest measured bin within ``reach`` (Å⁻¹; the least index of equals) of where the node is predicted.  The shell out to twice
    the reach gives background and noise (median and 1.4826·MAD); the excess must be ``least`` times the noise.  status: centred, or why not:
    ``no_bins`` in reach or under ``least_shell`` in the shell, ``weak``, ``unsettled``.  A node whose box leaves the grid is not searched.
    ``window`` is the σ of the centring window in bins.
    volumes may carry ``ub_now``, the orientation that predicts.  One join for all boxes; a task holds one node's box.
    """
    v = volumes.select("volume_id", *[c for c in (*_VOLUME, "ub_now") if c in volumes.columns])
    p = predicted_nodes(v, cell, window).filter(F.col("q") >= q_min)
    p = p if q_max is None else p.filter(F.col("q") <= q_max)
    p = p.withColumn("outer", F.greatest(F.lit(2 * reach), reach + 3 * F.col("width")))
    for r, a in enumerate("hkl"):
        half = F.col("outer") * F.col("per")[r] * F.abs(F.col(f"d{a}"))
        first, last = F.col(f"{a}0"), F.col(f"{a}0") + (F.col(f"n{a}") - 1) * F.col(f"d{a}")
        p = p.filter((F.col(f"c{a}") - half >= F.least(first, last)) & (F.col(f"c{a}") + half <= F.greatest(first, last)))
        p = p.withColumn(f"i{a}", F.rint((F.col(f"c{a}") - F.col(f"{a}0")) / F.col(f"d{a}")).cast("int"))
    keep = [*_VOLUME, "ch", "ck", "cl", "gh", "gk", "gl", "width", "outer"]
    j = _box(p, bins, _half(F.col("outer")), keep).select("volume_id", "peak_id", "gh", "gk", "gl", "ub", "ch", "ck", "cl", "width", "ih", "ik", "il", "xh", "xk", "xl", "intensity")

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ih", "ik", "il"])
        r = pdf.iloc[0]
        out = dict(volume_id=r.volume_id, nh=r.gh, nk=r.gk, nl=r.gl, peak_id=r.peak_id, ch=None, ck=None, cl=None, excess=None, significance=None)
        ub = np.array(r.ub, float).reshape(3, 3)
        q, value = pdf[["xh", "xk", "xl"]].to_numpy(float) @ ub.T, pdf["intensity"].to_numpy(float)
        away = np.linalg.norm(q, axis=1)
        inner, shell = away <= reach, (away > reach) & (away <= 2 * reach)
        if not inner.any() or shell.sum() < least_shell:
            return pd.DataFrame([out | {"status": "no_bins"}])
        background = np.median(value[shell])
        noise = MAD_TO_SIGMA * np.median(np.abs(value[shell] - background))
        top = int(np.argmax(np.where(inner, value, -np.inf)))
        excess = value[top] - background
        z = excess / noise if noise > 0 else (np.inf if excess > 0 else 0.0)
        out |= dict(excess=excess, significance=z)
        if not excess > 0 or z < least:
            return pd.DataFrame([out | {"status": "weak"}])
        at = windowed_centre(q, value - background, q[top], r.width, reach)
        if at is None:
            return pd.DataFrame([out | {"status": "unsettled"}])
        hkl = np.array([r.ch, r.ck, r.cl]) + np.linalg.inv(ub) @ at
        return pd.DataFrame([out | dict(ch=hkl[0], ck=hkl[1], cl=hkl[2], status="centred")])

    return j.groupBy("volume_id", "peak_id").applyInPandas(centre, _NODE).drop("peak_id")


def refined_orientation(bins: DataFrame, volumes: DataFrame, kind: str = "orientation", passes: int = 3, q_max: float | None = None, **search) -> tuple[DataFrame, DataFrame]:
    """Centres of all nodes and the fitted UB of each volume, found in passes that reach further out in |Q|.

    Pass i of ``passes`` measures the nodes up to (i + 1)/passes of the limit (the farthest corner of the largest box by default) where the
    UB of the pass before puts them.  A volume with too few centres for a fit keeps what it had.  Both tables of the last pass:
    :func:`measured_centres`, and :func:`~gridloom.operators.cells.ub_fit` with ``pass`` counted from 1.
    """
    v = volumes
    if q_max is None:
        far = [q_vector(F.col("ub"), *[F.col(f"{a}0") + (F.col(f"n{a}") - 1) * F.col(f"d{a}") * s for a, s in zip("hkl", corner, strict=True)]) for corner in np.ndindex(2, 2, 2)]
        q_max = v.select(F.max(F.greatest(*[F.sqrt(x * x + y * y + z * z) for x, y, z in far])).alias("q")).first().q or 0.0
    centres = fit = None
    for i in range(passes):
        centres = saved(measured_centres(bins, v, q_max=q_max * (i + 1) / passes, **search))
        good = centres.filter("status = 'centred'").join(volumes.select("volume_id", "ub"), "volume_id").withColumn("w", F.lit(1.0))
        fit = saved(ub_fit(good, kind).withColumn("pass", F.lit(i + 1)))  # one row a volume
        v = volumes.join(fit.select("volume_id", F.col("fitted").alias("ub_now")), "volume_id", "left")
    return centres, fit
