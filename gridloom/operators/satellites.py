"""Sharp peaks off the lattice: do they bunch at one commensurate fraction, and are they a second grain?"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lattice import grid

Matrix = tuple[int, ...]
IDENTITY: tuple[Matrix, ...] = ((1, 0, 0, 0, 1, 0, 0, 0, 1),)
#: The chance at which a bunching counts, before it is shared among the tests, and the hits it needs.
ALPHA, LEAST_HITS = 1.35e-3, 3
#: A bunching is clear with so many times the hits of chance, and such a share of them on the lattice in the other coordinates.
CLEAR_TIMES, CLEAR_SHARE = 2.0, 0.5
_SLACK = 1e-9


def forms_of(ops: Sequence[Matrix], axis: int) -> tuple[tuple[int, int, int], ...]:
    """What the coordinate of an axis becomes under the operations, up to sign."""
    out = set()
    for m in ops:
        row = m[3 * axis : 3 * axis + 3]
        lead = next(x for x in row if x)
        out.add(tuple(x if lead > 0 else -x for x in row))
    return tuple(sorted(out, reverse=True))


def coordinates(ops: Sequence[Matrix]) -> list[tuple[int, tuple[tuple[int, int, int], ...]]]:
    """(axis, forms) of each of h, k, l that is no equivalent of an earlier one."""
    seen, out = set(), []
    for axis in range(3):
        forms = forms_of(ops, axis)
        if forms not in seen:
            seen.add(forms)
            out.append((axis, forms))
    return out


def period(form: Sequence[int], cell: Sequence[int]) -> int:
    return math.gcd(*(abs(f) * c for f, c in zip(form, cell, strict=True) if f))


def _value(form: Sequence[int], x: Sequence[Column]) -> Column:
    return sum((c * v for c, v in zip(form, x, strict=True) if c), F.lit(0.0))


def _away(x: Column, p: int, q: int) -> tuple[Column, Column]:
    """Distance of x from the nearest p/q·k of a period p, and whether k is prime to q."""
    k = F.rint(x * q / p)
    prime = [j for j in range(1, q) if math.gcd(j, q) == 1]
    return F.abs(x - k * p / q), F.pmod(k, F.lit(q)).cast("int").isin(prime)


def _flat(x: Column, step: Column, p: int) -> Column:
    """Whether x is within a step of a node's plane."""
    return F.abs(x - F.rint(x / p) * p) <= step + _SLACK


def binomial_tail(hits: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X ≥ hits) of n trials: the sum of the terms, each by logarithms of factorials."""
    out = []
    for k, m, share in zip(hits, n, p, strict=True):
        if k <= 0 or not 0 < share < 1:
            out.append(1.0 if k <= 0 or share >= 1 else 0.0)
            continue
        terms = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(share) + (m - i) * math.log1p(-share) for i in range(int(k), int(m) + 1)]
        top = max(terms, default=-math.inf)
        out.append(min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms)) if terms else 0.0)
    return pd.Series(out)


def representatives(peaks: DataFrame, ops: Sequence[Matrix] = IDENTITY) -> DataFrame:
    """One peak (volume_id, h, k, l) of each symmetry orbit: the least image, rounded to four places to compare."""
    x = [F.col(a) for a in "hkl"]
    images = F.array(*[F.array(*[F.round(_value(m[3 * r : 3 * r + 3], x), 4) + 0.0 for r in range(3)]) for m in ops])
    p = peaks.withColumn("_key", F.array_min(images))
    return p.groupBy("volume_id", "_key").agg(F.min(F.struct("h", "k", "l")).alias("_p")).select("volume_id", "_p.h", "_p.k", "_p.l")


def bunching_counts(peaks: DataFrame, volumes: DataFrame, eligible: DataFrame | None = None, ops: Sequence[Matrix] = IDENTITY, cell: Sequence[int] = (1, 1, 1), most: int = 32) -> DataFrame:
    """A row for each volume, coordinate and denominator that its grid keeps apart: hits of n peaks, chance p0, mean distance, hits on the lattice aside.

    peaks: (volume_id, h, k, l), the sharp ones off the lattice; eligible: the bins a peak could be found in (the whole grid by default).  Peaks and
    bins within a step of a node on all axes count for nothing, and each orbit counts once.  A peak hits a denominator q when an equivalent of it is
    within a step of a fraction p/q of the coordinate's period, p prime to q; p0 is the share of the bins for which that holds.  Denominators go up
    to 1/q > 2 steps, at most ``most``.  One reading of the peaks and one of the bins, whatever the number of tests: each test is a sum.
    """
    steps = {a: F.abs(F.col(f"d{a}")) for a in "hkl"}
    v = volumes.select("volume_id", *[f"{x}{a}" for a in "hkl" for x in ("n", "d")], *[f"{a}0" for a in "hkl"])
    plans = coordinates(ops)
    least_step = v.select(*[F.min(F.when(F.col(f"n{a}") > 1, steps[a])).alias(a) for a in "hkl"]).first()

    def top_q(axis: int) -> int:
        s = least_step["hkl"[axis]]
        return 1 if not s else min(most, math.ceil(cell[axis] / (2 * s) * (1 - 1e-9)) - 1)

    tests = [(axis, forms, q) for axis, forms in plans for q in range(2, top_q(axis) + 1)]
    own = lambda axis, q: (F.col(f"n{'hkl'[axis]}") > 1) & (q * 2 * steps["hkl"[axis]] / cell[axis] < 1 - 1e-9)
    x = [F.col(a) for a in "hkl"]
    at_node = F.lit(True)
    for i, a in enumerate("hkl"):
        at_node = at_node & _flat(x[i], F.when(F.col(f"n{a}") > 1, steps[a]).otherwise(0.0), cell[i])

    def nearest(axis: int, forms, q: int) -> Column:
        """Least distance of x from a fraction, null beyond a step of all."""
        out = []
        for f in forms:
            away, prime = _away(_value(f, x), period(f, cell), q)
            out.append(F.when(prime & (away <= steps["hkl"[axis]] + _SLACK), away))
        return F.least(*out) if len(out) > 1 else out[0]

    def aside(axis: int, q: int) -> Column:
        """Whether an image of x hits along its own axis and lies on the lattice along the others."""
        out = F.lit(False)
        for m in ops:
            img = [_value(m[3 * r : 3 * r + 3], x) for r in range(3)]
            away, prime = _away(img[axis], cell[axis], q)
            ok = prime & (away <= steps["hkl"[axis]] + _SLACK)
            for j, a in enumerate("hkl"):
                if j != axis:
                    ok = ok & F.when(F.col(f"n{a}") > 1, _flat(img[j], steps[a], cell[j])).otherwise(True)
            out = out | ok
        return out

    def split(df: DataFrame, columns: list[Column], names: list[str]) -> DataFrame:
        """One aggregate for all tests, then a row for each."""
        each = F.array(*[F.struct(F.lit("hkl"[axis]).alias("coordinate"), F.lit(q).alias("denominator"), own(axis, q).alias("_own"), *[F.col(f"_{n}{i}").alias(n) for n in names]) for i, (axis, _, q) in enumerate(tests)])
        g = df.groupBy("volume_id").agg(*columns)
        return g.join(v, "volume_id").select("volume_id", "_n", F.explode(each).alias("_t")).filter("_t._own").select("volume_id", F.col("_n"), "_t.coordinate", "_t.denominator", *[f"_t.{n}" for n in names])

    schema = "volume_id string, coordinate string, denominator int, n long, hits long, distance double, aside long, p0 double"
    if not tests:
        return volumes.sparkSession.createDataFrame([], schema)
    b = (grid(v) if eligible is None else eligible.select("volume_id", "ih", "ik", "il").join(v.select("volume_id", "nh", "nk", "nl"), "volume_id")).drop("nh", "nk", "nl").join(v, "volume_id")
    for a in "hkl":
        b = b.withColumn(a, F.col(f"{a}0") + F.col(f"i{a}") * F.col(f"d{a}"))
    b = b.filter(~at_node)
    p = peaks.select("volume_id", "h", "k", "l").join(v, "volume_id").filter(~at_node)
    if eligible is not None:  # a peak counts where its bin does
        for a in "hkl":
            p = p.withColumn(f"i{a}", F.rint((F.col(a) - F.col(f"{a}0")) / F.col(f"d{a}")).cast("int"))
        p = p.join(eligible.select("volume_id", "ih", "ik", "il").distinct(), ["volume_id", "ih", "ik", "il"], "left_semi")
    p = representatives(p, ops).join(v, "volume_id")
    cover = [F.count(nearest(*t)).alias(f"_inside{i}") for i, t in enumerate(tests)]
    share = split(b, [F.count("*").alias("_n"), *cover], ["inside"]).select("volume_id", "coordinate", "denominator", (F.col("inside") / F.col("_n")).alias("p0"))
    hits = []
    for i, t in enumerate(tests):
        near = nearest(*t)
        hits += [F.count(near).alias(f"_hits{i}"), F.avg(near).alias(f"_distance{i}"), F.count_if(near.isNotNull() & aside(t[0], t[2])).alias(f"_aside{i}")]
    got = split(p, [F.count("*").alias("_n"), *hits], ["hits", "distance", "aside"]).withColumnRenamed("_n", "n")
    return got.join(share, ["volume_id", "coordinate", "denominator"])


def bunching(counts: DataFrame, alpha: float = ALPHA, least: int = LEAST_HITS) -> DataFrame:
    """counts with ``p_value``, ``tests``, ``fired``, ``clear`` and ``best``: the fired test of a volume whose hits lie nearest (then the smaller denominator, then h before k before l).

    A test fires when the binomial tail is at or under alpha shared among the volume's tests.
    """
    tail = F.pandas_udf(binomial_tail, "double")
    tests = counts.groupBy("volume_id").agg(F.count("*").alias("tests"))
    c = counts.join(tests, "volume_id").withColumn("p_value", tail("hits", "n", "p0"))
    c = c.withColumn("fired", (F.col("hits") >= least) & (F.col("p0") > 0) & (F.col("p0") < 1) & (F.col("p_value") <= alpha / F.col("tests")))
    c = c.withColumn("clear", F.col("fired") & (F.col("hits") >= CLEAR_TIMES * F.col("n") * F.col("p0")) & (F.col("aside") >= CLEAR_SHARE * F.col("hits")))
    order = F.struct(F.round("distance", 9).alias("d"), F.col("denominator").alias("q"), F.col("coordinate").alias("c"))
    best = c.filter("fired").groupBy("volume_id").agg(F.min(order).alias("_b")).select("volume_id", F.col("_b.q").alias("denominator"), F.col("_b.c").alias("coordinate"), F.lit(True).alias("best"))
    return c.join(best, ["volume_id", "coordinate", "denominator"], "left").withColumn("best", F.coalesce("best", F.lit(False)))


# --- a second grain ---------------------------------------------------------------------------------------


def _lattice_rotations(b: np.ndarray) -> list[np.ndarray]:
    """Proper rotations of a lattice (columns of b), as integer matrices in its own basis."""
    g = b.T @ b
    m = np.stack(np.meshgrid(*[np.array([-1, 0, 1])] * 9, indexing="ij"), -1).reshape(-1, 3, 3)
    m = m[np.rint(np.linalg.det(m)) == 1]
    same = np.abs(np.einsum("nji,jk,nkl->nil", m, g, m) - g).max((1, 2)) < 1e-6 * np.abs(g).max()
    return list(m[same]) or [np.eye(3, dtype=int)]


def _frames(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Right-handed frames of pairs of vectors (…, 3), first along a, third across both; as columns."""
    x = a / np.linalg.norm(a, axis=-1, keepdims=True)
    z = np.cross(a, b)
    z = z / np.linalg.norm(z, axis=-1, keepdims=True)
    return np.stack([x, np.cross(z, x), z], -1)


def best_rotation(images: np.ndarray, b: np.ndarray, length: float = 0.03, degrees: float = 1.0, reach: float = 0.05, pairs: int = 6) -> tuple[int, np.ndarray | None]:
    """The turn of a lattice (columns of b) that puts most peaks on its nodes: (peaks explained, rotation).

    images: peaks × equivalents × 3 in Q, strongest first.  Candidates turn two nodes onto two of the strongest peaks of the same lengths and
    the same angle; a peak is explained when any equivalent of it lies within ``reach`` of a node.  All candidates of a pair are scored at once.
    """
    q = images[:, 0]
    if len(q) < 2:
        return 0, None
    far = np.linalg.norm(q, axis=1).max() + 0.2
    m = math.ceil(far / np.linalg.norm(b, axis=0).min()) + 1
    nodes = np.stack(np.meshgrid(*[np.arange(-m, m + 1)] * 3, indexing="ij"), -1).reshape(-1, 3) @ b.T
    size = np.linalg.norm(nodes, axis=1)
    nodes, size = nodes[(size > 0) & (size <= far)], size[(size > 0) & (size <= far)]
    cosine = lambda x, y: np.clip((x * y).sum(-1) / (np.linalg.norm(x, axis=-1) * np.linalg.norm(y, axis=-1)), -1, 1)
    best, turn = 0, None
    for i in range(min(pairs, len(q))):
        for j in range(i + 1, min(pairs, len(q))):
            angle = np.degrees(np.arccos(cosine(q[i], q[j])))
            if not 5 <= angle <= 175:
                continue
            first, second = (nodes[np.abs(size - np.linalg.norm(q[k])) < length] for k in (i, j))
            if not len(first) or not len(second):
                continue
            near = np.abs(np.degrees(np.arccos(cosine(first[:, None], second[None]))) - angle) <= degrees
            x, y = np.nonzero(near)
            for lo in range(0, len(x), 2000):
                r = _frames(q[i], q[j]) @ np.swapaxes(_frames(first[x[lo : lo + 2000]], second[y[lo : lo + 2000]]), -1, -2)
                rb = r @ b
                hkl = np.einsum("cij,pej->cpei", np.linalg.inv(rb), images)
                miss = np.linalg.norm(np.einsum("cij,cpej->cpei", rb, hkl - np.floor(hkl + 0.5)), axis=-1)
                hits = (miss < reach).any(-1).sum(-1)
                if len(hits) and hits.max() > best:
                    best, turn = int(hits.max()), r[int(hits.argmax())]
    return best, turn


def _directions(n: int) -> np.ndarray:
    """n control directions, the same on every run."""
    # fixed values: multiplier, increment and seed of the generator that the control uses
    multiplier, increment, state = 1664525, 1013904223, 7
    out = np.empty((n, 3))
    for i in range(3 * n):
        state = (multiplier * state + increment) % 2**32
        out.flat[i] = state / 2**32 - 0.5
    return out / np.linalg.norm(out, axis=1)[:, None]


_GRAINS = (
    "volume_id string, orbits int, judged int, beside_nodes int, offset_low double, offset_median double, offset_high double, indexed int, misorientation double, control int"
)


def grain_check(peaks: DataFrame, volumes: DataFrame, ops: Sequence[Matrix] = IDENTITY, cell: Sequence[int] = (1, 1, 1), top: int = 40, same: float = 0.15) -> DataFrame:
    """Are the off-lattice peaks (volume_id, h, k, l, intensity) of a volume another grain, or its own peaks beside their nodes?

    Peaks within ``same`` r.l.u. of an image of a stronger one are its orbit; the ``top`` strongest orbits are judged (a report of the strongest, as
    their rank says).  ``beside_nodes`` counts those within a quarter of the node spacing of a node, with quartiles of their angle in degrees.  ``indexed`` is the most
    orbits that one rotation of the lattice puts on nodes, ``misorientation`` its least angle under the lattice's own rotations (null without a candidate), and
    ``control`` the same search's score with the peaks at random directions.  A grouped map over the peaks of one volume.
    """
    group = np.array(ops, float).reshape(-1, 3, 3)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["intensity", "h", "k", "l"], ascending=[False, True, True, True])
        hkl = pdf[["h", "k", "l"]].to_numpy(float)
        taken, reps = np.zeros(len(hkl), bool), []
        for i in range(len(hkl)):
            if not taken[i]:
                reps.append(i)
                for image in group @ hkl[i]:
                    taken |= np.linalg.norm(hkl - image, axis=1) < same
                taken[i] = True
        ub = np.array(pdf.ub.iloc[0], float).reshape(3, 3)
        b = ub * np.array(cell, float)
        judged = hkl[reps[:top]]
        node = np.array(cell) * np.floor(judged / np.array(cell) + 0.5)
        offset, length = np.linalg.norm((judged - node) @ ub.T, axis=1), np.linalg.norm(node @ ub.T, axis=1)
        beside = (offset <= np.linalg.norm(b, axis=0).min() / 4) & (length > 0)
        angle = np.sort(np.degrees(offset[beside] / length[beside]))
        at = lambda s: float(angle[min(len(angle) - 1, int(s * len(angle)))]) if len(angle) else None
        images = np.einsum("ij,gjk,pk->pgi", ub, group, judged)
        indexed, turn = best_rotation(images, b)
        mis = None
        if turn is not None:
            traces = [np.trace(b @ o @ np.linalg.inv(b) @ turn) for o in _lattice_rotations(b)]
            mis = float(np.degrees(np.arccos(np.clip((max(traces) - 1) / 2, -1, 1))))
        random = _directions(len(judged) * len(group)).reshape(len(judged), len(group), 3) * np.linalg.norm(judged @ ub.T, axis=1)[:, None, None]
        control, _ = best_rotation(random, b)
        row = (pdf.volume_id.iloc[0], len(reps), len(judged), int(beside.sum()), at(0.25), at(0.5), at(0.75), indexed, mis, control)
        return pd.DataFrame([row], columns=[c.split()[0] for c in _GRAINS.split(", ")])

    j = peaks.select("volume_id", "h", "k", "l", "intensity").join(volumes.select("volume_id", "ub"), "volume_id")
    return j.groupBy("volume_id").applyInPandas(judge, _GRAINS)


__all__ = ["best_rotation", "binomial_tail", "bunching", "bunching_counts", "grain_check", "representatives"]
