"""Tails that a turned orientation leaves beside the holes of a punch, swept along ω × Q.

Each node's window is read by one join and judged in a grouped map over that window alone; what looks across nodes (the share of a |Q| shell
that the sweep may take) is a group-by over the bins added.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import measured
from .lattice import BINKEY, saved
from .shapes import _VOLUME, MAD_TO_SIGMA, _box, _with_volume

#: Least shift of a node, the room beyond it, and the band around the search, in bins.
LEAST_SHIFT, EXTRA_BINS, BAND = 0.5, 1.0, 2
#: σ down to which a tail that passed the gate is followed.
GROW = 3.0
#: Bins of a ring that give a level of their own.
RING_BINS = 8
#: A sweep may add so many times its hole, and take such a share of the measured bins of a |Q| shell (Å⁻¹).
GROWTH, SHELL, SHELL_SHARE = 1.0, 0.25, 0.02
#: A tail is at most this much wider than the peak's core across ω × Q, and this part of a bin.
WIDER, WIDER_BINS = 1.4, 0.25


def grown(seed: np.ndarray, mask: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """seed and what of mask is connected to it (corners included) within so many steps; without mask's limit where it is all true."""
    part = seed.copy()
    left = -1 if rounds is None else rounds
    while left:
        wide = part
        for axis in range(3):  # a cube's neighbourhood, one axis after another
            wide = wide.copy()
            head, tail = [slice(None)] * 3, [slice(None)] * 3
            head[axis], tail[axis] = slice(1, None), slice(None, -1)
            before = wide.copy()
            wide[tuple(head)] |= before[tuple(tail)]
            wide[tuple(tail)] |= before[tuple(head)]
        new = part | (wide & mask)
        if (new == part).all():
            break
        part, left = new, left - 1
    return part


def in_capsule(d: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether offsets lie in the ellipsoid of a moved from −s to s."""
    along, size = d @ a @ s, float(s @ a @ s)
    t = np.clip(along / size, -1, 1) if size > 0 else np.zeros(d.shape[:-1])
    rest = d - t[..., None] * s
    return np.einsum("...i,ij,...j", rest, a, rest) <= 1.0


def distance_to(own: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Euclidean distance of each bin of a small box to the nearest of own; bins have these edges.

    Exact: the squared distance along one axis, then lower envelopes along the next two.
    """
    d2 = np.where(own, 0.0, np.inf)
    for axis, e in enumerate(edges):
        n = d2.shape[axis]
        apart = ((np.arange(n)[:, None] - np.arange(n)) * e) ** 2
        moved = np.moveaxis(d2, axis, -1)
        d2 = np.moveaxis((moved[..., None, :] + apart).min(-1), -1, axis)
    return np.sqrt(d2)


_NODE = (
    "volume_id string, peak_id long, status string, q double, shift double, hole int, tail_before int, excess_before double, removed int, excess_removed double,"
    " added array<struct<ih:int,ik:int,il:int>>"
)


def sweep_tails(bins: DataFrame, volumes: DataFrame, holes: DataFrame, rotation: DataFrame, gate: float = 5.0, grow: float = GROW) -> tuple[DataFrame, DataFrame]:
    """(nodes, added): what the sweep finds at each hole whose node the rotation moves by half a bin or more, and the bins it adds.

    bins: with ``punched``, and ``protected`` if something is declared.  holes: (volume_id, peak_id, nh, nk, nl, ih, ik, il, ch, ck, cl, shape), and if they have
    them ``stretch`` (r.l.u., three) of the punch and ``guard`` (half-width about the node's h that no tail leaves).  rotation: (volume_id, wx, wy, wz) in radians, one row
    a volume.  The search region is the hole swept along ±ω × Q by the shift and a bin; the level at each distance from the hole is the
    median of the unpunched bins outside the region; a tail starts at the hole above ``gate`` σ and is followed down to ``grow`` σ.
    status: swept, clean, extended (it leaves the region), capped (larger than its hole), shell_capped, broad (wider than the core), no_hole, and
    unlisted nodes are not moved enough.  Nodes are counted and swept independently; a bin two nodes add is one row of ``added``.
    """
    flag = F.coalesce(F.col("protected"), F.lit(False)) if "protected" in bins.columns else F.lit(False)
    p = _with_volume(holes, volumes).join(rotation.select("volume_id", "wx", "wy", "wz"), "volume_id")
    p = p.withColumn("stretch", F.col("stretch") if "stretch" in holes.columns else F.lit(None).cast("array<double>"))
    p = p.withColumn("guard", F.col("guard") if "guard" in holes.columns else F.lit(None).cast("double"))

    def room(ub, shape, stretch, w, node, steps) -> list[int] | None:
        ub, a = np.array(ub, float).reshape(3, 3), np.array(shape, float).reshape(3, 3)
        edge = (abs(np.linalg.det(ub)) * np.prod(steps)) ** (1 / 3)
        shift = np.cross(w, ub @ node)
        d = float(np.linalg.norm(shift))
        if not d >= LEAST_SHIFT * edge:
            return None
        first = 0.0 if stretch is None else float(np.linalg.norm(ub @ np.array(stretch, float)))
        s = np.linalg.inv(ub) @ ((first + d + EXTRA_BINS * edge) * shift / d)
        reach = np.sqrt(np.maximum(np.diag(np.linalg.inv(a)), 0)) + np.abs(s)
        return [*(np.ceil(reach / steps).astype(int) + BAND + 2).tolist()]

    def rooms(batches):
        for b in batches:
            out = b[["volume_id", "peak_id"]].copy()
            st = [None if s is None or (isinstance(s, float) and np.isnan(s)) else s for s in b["stretch"]]
            rows = zip(b["ub"], b["shape"], st, b[["wx", "wy", "wz"]].to_numpy(float), b[["nh_", "nk_", "nl_"]].to_numpy(float), np.abs(b[["dh", "dk", "dl"]].to_numpy(float)), strict=True)
            out["half"] = [room(*r) for r in rows]
            yield out[out["half"].notna()]

    p = p.select("volume_id", "peak_id", *_VOLUME, *[F.col(f"i{a}") for a in "hkl"], "ch", "ck", "cl", "shape", "stretch", "guard", "wx", "wy", "wz")
    nodes = holes.select("volume_id", "peak_id", *[F.col(f"n{a}").alias(f"n{a}_") for a in "hkl"])
    p = p.filter("shape is not null").join(nodes, ["volume_id", "peak_id"])
    half = p.mapInPandas(rooms, "volume_id string, peak_id long, half array<int>")
    p = p.join(half, ["volume_id", "peak_id"])
    keep = [*_VOLUME, "ch", "ck", "cl", "shape", "stretch", "guard", "wx", "wy", "wz", "nh_", "nk_", "nl_", "half"]
    state = bins.filter(measured()).select(*BINKEY, F.col("punched").alias("_punched"), flag.alias("_protected"))
    j = _box(p, bins, [F.col("half")[i] for i in range(3)], keep).join(state, BINKEY)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        ub, a, node = np.array(r.ub, float).reshape(3, 3), np.array(r["shape"], float).reshape(3, 3), np.array([r.nh_, r.nk_, r.nl_], float)
        steps = np.abs([r.dh, r.dk, r.dl])
        edge, edges = (abs(np.linalg.det(ub)) * np.prod(steps)) ** (1 / 3), np.linalg.norm(ub, axis=0) * steps
        shift = np.cross([r.wx, r.wy, r.wz], ub @ node)
        d = float(np.linalg.norm(shift))
        u = shift / d
        s1 = np.zeros(3) if r.stretch is None else np.array(r.stretch, float)
        s = np.linalg.inv(ub) @ ((float(np.linalg.norm(ub @ s1)) + d + EXTRA_BINS * edge) * u)
        out = dict(volume_id=r.volume_id, peak_id=r.peak_id, status="no_hole", q=float(np.linalg.norm(ub @ node)), shift=d, hole=0)
        out |= dict(tail_before=0, excess_before=0.0, removed=0, excess_removed=0.0, added=[])

        def done(status: str) -> pd.DataFrame:
            return pd.DataFrame([out | {"status": status}])

        n = np.array([r.nh, r.nk, r.nl])
        middle, half = np.array([r._ph, r._pk, r._pl]), np.array(r.half)
        first = np.maximum(middle - half, 0)
        shape = tuple(np.minimum(middle + half, n - 1) - first + 1)
        at = tuple((pdf[["ih", "ik", "il"]].to_numpy() - first).T)

        def box(values, empty):
            x = np.full(shape, empty)
            x[at] = values
            return x

        axes = [np.array([r.h0, r.k0, r.l0])[i] + (first[i] + np.arange(shape[i])) * [r.dh, r.dk, r.dl][i] for i in range(3)]
        hkl = np.stack(np.meshgrid(*axes, indexing="ij"), -1)
        off = hkl - np.array([r.ch, r.ck, r.cl])
        value, sigma = box(pdf.intensity, 0.0), box(pdf.sigma, 0.0)
        seen, punched = box(True, False), box(pdf._punched, False)
        own = in_capsule(off, a, s1) & seen & punched
        out["hole"] = int(own.sum())
        if not own.any():
            return done("no_hole")
        region = in_capsule(off, a, s)
        around = grown(region, np.ones(shape, bool), BAND)
        allowed = seen & ~punched & ~box(pdf._protected, False)
        if r.guard is not None and not np.isnan(r.guard):
            allowed &= np.abs(hkl[..., 0] - node[0]) <= max(float(r.guard), 0.0)
        across = allowed & ~around
        if across.sum() < RING_BINS:
            return done("no_hole")
        ring = np.floor(distance_to(own, edges) / edge + 1e-9).astype(int)
        spread = lambda x: MAD_TO_SIGMA * float(np.median(np.abs(x - np.median(x))))
        level, scatter = np.full(ring.max() + 1, np.median(value[across])), np.full(ring.max() + 1, spread(value[across]))
        rings = pd.Series(value[across]).groupby(ring[across])
        for k, x in rings:
            if len(x) >= RING_BINS:
                level[k], scatter[k] = np.median(x), spread(x.to_numpy())
        excess = value - level[ring]
        with np.errstate(divide="ignore", invalid="ignore"):
            z = excess / np.where(sigma > 0, sigma, scatter[ring])
        bright = allowed & (z >= gate)
        tail = bright & region
        out |= dict(tail_before=int(tail.sum()), excess_before=float(excess[tail].sum()))
        found = grown(bright & grown(own, np.ones(shape, bool), 1), bright & around) if (bright & around).any() else np.zeros(shape, bool)
        found &= bright & around
        if (found & ~region).any():
            return done("extended")
        if found.any() and grow < gate:
            found = grown(found, found | (allowed & region & (z >= grow)))
        if not found.any():
            return done("clean")
        if found.sum() > GROWTH * out["hole"]:
            return done("capped")
        dq = off @ ub.T
        beside = (dq**2).sum(-1) - (dq @ u) ** 2
        width = lambda m: math.sqrt(max(float((excess[m] * beside[m]).sum() / excess[m].sum()), 0.0)) if m.any() else math.nan
        core, arm = own & (excess > 0), found & (excess > 0)
        if width(arm) > WIDER * width(core) + WIDER_BINS * edge:
            return done("broad")
        out |= dict(removed=int((found & tail).sum()), excess_removed=float(excess[found & tail].sum()))
        out["added"] = [dict(zip(("ih", "ik", "il"), map(int, x), strict=True)) for x in np.argwhere(found) + first]
        return done("swept")

    nodes = saved(j.groupBy("volume_id", "peak_id").applyInPandas(judge, _NODE))
    added = nodes.filter("status = 'swept'").select("volume_id", "peak_id", F.inline("added"))
    shell = F.floor(F.col("q") / SHELL).alias("shell")
    have = bins if "q" in bins.columns else None
    if have is None:
        raise ValueError("bins without q")
    in_shell = added.join(bins.select(*BINKEY, "q"), BINKEY).select("volume_id", "peak_id", *BINKEY[1:], shell)
    taken = in_shell.groupBy("volume_id", "shell").agg(F.count("*").alias("_taken"))
    all_of = bins.filter(measured()).groupBy("volume_id", shell).agg(F.count("*").alias("_all"))
    over = taken.join(all_of, ["volume_id", "shell"]).filter(F.col("_taken") > SHELL_SHARE * F.col("_all"))
    lost = in_shell.join(over, ["volume_id", "shell"], "left_semi").select("volume_id", "peak_id").distinct()
    nodes = nodes.drop("added").join(lost.withColumn("_lost", F.lit(True)), ["volume_id", "peak_id"], "left")
    capped = F.coalesce("_lost", F.lit(False))
    nodes = nodes.withColumn("status", F.when(capped, "shell_capped").otherwise(F.col("status"))).drop("_lost")
    added = added.join(lost, ["volume_id", "peak_id"], "left_anti").select(*BINKEY).distinct()
    return nodes, added


def apply_sweep(bins: DataFrame, added: DataFrame) -> DataFrame:
    """bins with ``punched`` also where the sweep added."""
    j = bins.join(added.select(*BINKEY).distinct().withColumn("_a", F.lit(True)), BINKEY, "left")
    return j.withColumn("punched", F.col("punched") | F.coalesce("_a", F.lit(False))).drop("_a")
