"""Unit cells and orientation: matrices from cells and back, Laue classes a lattice allows, rotations, fits to centres."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import inverse

Matrix = tuple[int, ...]

# The generators of each Laue class as images of (h, k, l).
LAUE_CLASSES: dict[str, str] = {
    "-1": "-h,-k,-l",
    "2/m (b unique)": "-h,k,-l; -h,-k,-l",
    "2/m (c unique)": "-h,-k,l; -h,-k,-l",
    "mmm": "-h,-k,l; -h,k,-l; -h,-k,-l",
    "4/m": "k,-h,l; -h,-k,-l",
    "4/mmm": "k,-h,l; h,-k,-l; -h,-k,-l",
    "-3": "k,-h-k,l; -h,-k,-l",
    "-3m1": "k,-h-k,l; h,-h-k,-l; -h,-k,-l",
    "-31m": "k,-h-k,l; -k,-h,-l; -h,-k,-l",
    "6/m": "h+k,-h,l; -h,-k,-l",
    "6/mmm": "h+k,-h,l; -k,-h,-l; -h,-k,-l",
    "m-3": "k,l,h; -h,-k,l; -h,k,-l; -h,-k,-l",
    "m-3m": "k,l,h; k,-h,l; -h,-k,-l",
}
#: Largest relative change of the metric that a symmetry operation may make.
METRIC_LIMIT = 0.02


def operation(text: str) -> Matrix:
    """The row-major matrix of an image such as "k,-h-k,l"."""
    rows = [x.replace(" ", "").replace("-", "+-").split("+") for x in text.split(",")]
    return tuple(sum({t: 1, f"-{t}": -1}.get(p, 0) for p in row) for row in rows for t in "hkl")


def closed(generators: Sequence[Matrix]) -> tuple[Matrix, ...]:
    """All products of the generators, the identity first; more than 48 are no point group of a lattice."""
    times = lambda a, b: tuple(sum(a[3 * r + j] * b[3 * j + c] for j in range(3)) for r in range(3) for c in range(3))
    group, new = [(1, 0, 0, 0, 1, 0, 0, 0, 1)], [(1, 0, 0, 0, 1, 0, 0, 0, 1)]
    while new:
        new = [p for p in dict.fromkeys(times(a, g) for a in new for g in generators) if p not in group]
        group += new
        if len(group) > 48:
            raise ValueError("the operations do not close into a point group")
    return tuple(group)


def laue_operations(name: str) -> tuple[Matrix, ...]:
    return closed([operation(t) for t in LAUE_CLASSES[name].split(";")])


def ub_of_cell(a: Column, b: Column, c: Column, al: Column, be: Column, ga: Column) -> list[Column]:
    """UB (row-major, 2π included) of a cell in Å and degrees: a* along x, b* in the xy plane, no turn."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in (al, be, ga))
    sa, sb, sg = (F.sin(F.radians(x)) for x in (al, be, ga))
    root = F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)  # the volume over abc
    ra, rb, rc = sa / (a * root), sb / (b * root), sg / (c * root)
    cos_b, cos_g = (ca * cg - cb) / (sa * sg), (ca * cb - cg) / (sa * sb)
    sin_b, sin_g = F.sqrt(1 - cos_b * cos_b), F.sqrt(1 - cos_g * cos_g)
    zero = F.lit(0.0)
    return [2 * math.pi * x for x in (ra, rb * cos_g, rc * cos_b, zero, rb * sin_g, -rc * sin_b * ca, zero, zero, 1 / c)]


def cell_of_ub(ub: Column) -> list[Column]:
    """a, b, c (Å) and α, β, γ (degrees) of a UB matrix: the lengths and angles of the rows of 2π·UB⁻¹."""
    m = inverse([ub[i] for i in range(9)])
    v = [[2 * math.pi * m[3 * r + j] for j in range(3)] for r in range(3)]
    dot = lambda r, s: v[r][0] * v[s][0] + v[r][1] * v[s][1] + v[r][2] * v[s][2]
    n = [F.sqrt(dot(r, r)) for r in range(3)]
    angle = lambda r, s: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(r, s) / (n[r] * n[s])))))
    return [*n, angle(1, 2), angle(0, 2), angle(0, 1)]


def metric_of(ub: Column) -> list[Column]:
    """The reciprocal metric UBᵀ·UB, row-major."""
    return [ub[r] * ub[c] + ub[3 + r] * ub[3 + c] + ub[6 + r] * ub[6 + c] for r in range(3) for c in range(3)]


def laue_candidates(volumes: DataFrame, limit: float = METRIC_LIMIT) -> DataFrame:
    """Each Laue class on each volume: order, metric change, whether it is allowed, and why not.

    volumes: one row each (volume_id, ub, h0, k0, l0, dh, dk, dl).  A class is refused by ``metric`` if an operation
    changes UBᵀ·UB by more than ``limit`` of its largest element, and by ``grid`` if one maps a bin off the grid's points
    (steps that it mixes differ, or the start is off).  A volume without UB is not held against its metric; one with
    a null axis is refused by its grid.  The operations share few distinct elements of RᵀGR − G and offsets in bins: each
    is computed once for a batch of volumes, a class takes the largest of its own, and nothing is shuffled.
    """
    classes = {n: laue_operations(n) for n in LAUE_CLASSES}
    metric: dict[tuple, int] = {}
    grid: dict[tuple, int] = {}
    own: list[tuple[list[int], list[int]]] = []
    for ops in classes.values():
        turned = [(r, c, tuple((m[3 * i + r] * m[3 * j + c], 3 * i + j) for i in range(3) for j in range(3) if m[3 * i + r] * m[3 * j + c])) for m in ops for r in range(3) for c in range(r, 3)]
        moved = [(r, c, abs(m[3 * r + c])) for m in ops for r in range(3) for c in range(3)] + [(r, tuple(m[3 * r + c] - int(r == c) for c in range(3))) for m in ops for r in range(3)]
        own.append((sorted({metric.setdefault(k, len(metric)) for k in turned}), sorted({grid.setdefault(k, len(grid)) for k in moved})))
    n, names = len(classes), list(classes)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for v in batches:
            g = [v[f"g{i}"].to_numpy(float) for i in range(9)]
            start, step = [v[f"{a}0"].to_numpy(float) for a in "hkl"], [v[f"d{a}"].to_numpy(float) for a in "hkl"]
            with np.errstate(all="ignore"):
                change = [np.abs(sum(s * g[i] for s, i in terms) - g[3 * r + c]) for r, c, terms in metric]
                off = [k[2] * step[k[1]] / step[k[0]] if len(k) == 3 else sum(k[1][c] * start[c] for c in range(3)) / step[k[0]] for k in grid]
                off = [np.abs(x - np.rint(x)) for x in off]
                most = np.fmax.reduce([np.abs(x) for x in g])
                out = {f"c{i}": np.fmax.reduce([change[j] for j in own[i][0]]) / most for i in range(n)}
            out |= {f"o{i}": np.maximum.reduce([off[j] for j in own[i][1]]) for i in range(n)}  # NaN of a null axis stays
            yield pd.DataFrame({"volume_id": v["volume_id"], "bad": v["bad"], **out})

    g = metric_of(F.col("ub"))
    bad = F.lit(False)
    for x in g:
        bad = bad | F.coalesce(F.isnan(x), F.lit(False))
    v = volumes.select("volume_id", bad.alias("bad"), *[x.cast("double").alias(f"g{i}") for i, x in enumerate(g)], *[F.col(c).cast("double").alias(c) for c in ("h0", "k0", "l0", "dh", "dk", "dl")])
    j = v.mapInPandas(judged, "volume_id string, bad boolean, " + ", ".join(f"{x}{i} double" for x in "co" for i in range(n)))
    rows = [F.struct(F.lit(name).alias("laue"), F.lit(len(classes[name])).alias("operations"), F.col(f"c{i}").alias("change"), F.col(f"o{i}").alias("off")) for i, name in enumerate(names)]
    out = j.select("volume_id", "bad", F.explode(F.array(*rows)).alias("_o")).select("volume_id", "_o.laue", "_o.operations", F.when(F.col("bad"), F.lit(float("nan"))).otherwise(F.col("_o.change")).alias("change"), "_o.off")
    why = F.when(F.col("change") > limit, F.lit("metric")).when(F.coalesce("off", F.lit(1.0)) > 1e-3, F.lit("grid"))
    return out.select("volume_id", "laue", "operations", "change", why.isNull().alias("allowed"), why.alias("reason"))


def angle_axis(matrices: DataFrame) -> DataFrame:
    """matrices (m: array of nine, row-major) with the rotation's angle in degrees and unit axis; zero axis where v = 0."""
    m = F.col("m")
    d = matrices.withColumn("angle", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1) / 2)))))
    v = [m[7] - m[5], m[2] - m[6], m[3] - m[1]]
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return d.select("*", *[F.when(n > 1e-12, x / n).otherwise(0.0).alias(f"axis_{a}") for x, a in zip(v, "xyz", strict=True)])


def beyond(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f) of the F distribution: the incomplete beta integral by its series of positive terms, from the nearer end."""
    f, d1, d2 = (np.asarray(x, dtype=float) for x in (f, d1, d2))
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    turned = x > 0.5
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + gamma(a + b) - gamma(a) - gamma(b)) / a
    term, total = np.ones_like(x), np.ones_like(x)
    for n in range(100_000):
        term = term * (a + b + n) / (a + 1 + n) * x
        total += term
        if not (term > 1e-16 * total).any():
            break
    p = front * total
    return np.where(turned, 1 - p, p)


def _p_value(f: pd.Series, dof: pd.Series) -> pd.Series:
    """Tail of F with 3 and dof degrees of freedom; 1 without any, 0 for an infinite F."""
    x, d = f.to_numpy(dtype=float), dof.to_numpy(dtype=float)
    out = np.where(d > 0, 0.0, 1.0)
    ok = (d > 0) & np.isfinite(x)
    out[ok] = beyond(x[ok], np.full(ok.sum(), 3.0), d[ok])
    return pd.Series(out)


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _across(d: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    """The part of d across q."""
    t = (d[0] * q[0] + d[1] * q[1] + d[2] * q[2]) / (q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    return [d[i] - t * q[i] for i in range(3)]


def _sums(q: Sequence[Column], d: Sequence[Column], w: Column) -> dict[str, Column]:
    """What a rotation is solved from, to be summed over offsets d across q: normal matrix, right-hand side, square sum."""
    q2, cr = q[0] * q[0] + q[1] * q[1] + q[2] * q[2], _cross(q, d)
    out = {f"_m{i}{j}": w * ((q2 if i == j else F.lit(0.0)) - q[i] * q[j]) for i in range(3) for j in range(i, 3)}
    return out | {f"_b{i}": w * cr[i] for i in range(3)} | {"rss0": w * (d[0] * d[0] + d[1] * d[1] + d[2] * d[2])}


def _solved(g: DataFrame) -> DataFrame:
    """g, which has n and the columns of :func:`_sums` summed, with the rotation, square sums, R² and F."""
    m, b = [[F.col(f"_m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)], [F.col(f"_b{i}") for i in range(3)]
    minor = {(i, j): m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for i in range(3) for j in range(i, 3)}
    g = g.select("*", *[x.alias(f"_c{i}{j}") for (i, j), x in minor.items()])  # step by step: one expression of all would be too long to compile
    c = lambda i, j: F.col(f"_c{min(i, j)}{max(i, j)}")
    g = g.withColumn("_det", m[0][0] * c(0, 0) + m[0][1] * c(0, 1) + m[0][2] * c(0, 2)).withColumn("_tr", m[0][0] + m[1][1] + m[2][2])
    sound = F.col("_det") > 1e-8 * F.col("_tr") * F.col("_tr") * F.col("_tr")
    g = g.select("*", *[F.when(sound, (c(i, 0) * b[0] + c(i, 1) * b[1] + c(i, 2) * b[2]) / F.col("_det")).alias(f"w{a}") for i, a in enumerate("xyz")])
    g = g.withColumn("rss1", F.greatest(F.lit(0.0), F.col("rss0") - F.col("wx") * b[0] - F.col("wy") * b[1] - F.col("wz") * b[2])).withColumn("dof", 2 * F.col("n") - 3)
    r2 = F.when(F.col("rss0") > 0, 1 - F.col("rss1") / F.col("rss0")).otherwise(0.0)
    f = F.when((F.col("dof") > 0) & (F.col("rss1") > 0), (F.col("rss0") - F.col("rss1")) / 3 / (F.col("rss1") / F.col("dof")))
    f = f.otherwise(F.when(F.col("rss0") > F.col("rss1"), F.lit(math.inf)).otherwise(0.0))
    return g.select("*", r2.alias("r2"), F.when(F.col("wx").isNotNull(), f).alias("f_stat"))


_FIT = ("n", "wx", "wy", "wz", "rss0", "rss1", "dof", "r2", "f_stat")


def rotation_fit(offsets: DataFrame) -> DataFrame:
    """The small rotation ω minimising Σ w·|d⊥ − ω × q|² per volume, with sums of squares before and after, R² and F.

    offsets: (volume_id, qx, qy, qz, dx, dy, dz, w) at nodes with q ≠ 0; d⊥ is the part across q.  Ten sums from
    one combined group-by and a 3×3 solve in columns.  Null ω where the directions are all parallel.
    """
    q = [F.col(f"q{a}") for a in "xyz"]
    sums = _sums(q, _across([F.col(f"d{a}") for a in "xyz"], q), F.col("w"))
    return _solved(offsets.groupBy("volume_id").agg(*[F.sum(x).alias(c) for c, x in sums.items()], F.count("*").alias("n"))).select("volume_id", *_FIT)


def rotation_diagnosis(
    offsets: DataFrame, voxel: float, reject: float = 3.0, keep_within: float = 0.0, least: int = 4, p_limit: float = 1e-3, r2_limit: float = 0.5, rounds: int = 5
) -> DataFrame:
    """:func:`rotation_fit` without outliers, and its verdict: active, unresolved, not_explained or not_significant.

    An offset whose residual passes both ``reject`` times its volume's median and ``keep_within`` is left out and the
    fit repeated, at most ``rounds`` times; a volume left with fewer than ``least`` keeps what it had.  A rotation is
    resolved if it moves a node by half a ``voxel`` (Å⁻¹) or more.  All rounds are windows over a volume's offsets, so
    they share one shuffle and one sort; a round that changes nothing is repeated without effect.
    """
    own, used = Window.partitionBy("volume_id"), F.col("used")
    q, d = [F.col(f"q{a}") for a in "xyz"], [F.col(f"d{a}") for a in "xyz"]
    turn = _cross([F.col(f"w{a}") for a in "xyz"], q)
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    across = [x.alias(f"d{a}") for x, a in zip(_across(d, q), "xyz", strict=True)]
    o = offsets.filter("volume_id is not null").select("volume_id", *q, *across, F.col("w").alias("weight"), F.lit(True).alias("used"))
    sums = [F.sum(F.when(used, x)).over(own).alias(c) for c, x in _sums(q, d, F.col("weight")).items()]

    def fitted(o: DataFrame) -> DataFrame:
        return _solved(o.select("*", *sums, F.count_if(used).over(own).alias("n")))

    for _ in range(rounds):
        r = fitted(o).select(*o.columns, size([x - t for x, t in zip(d, turn, strict=True)]).alias("_r"))
        r = r.withColumn("_m", F.percentile(F.when(used, F.col("_r")), F.lit(0.5)).over(own))
        r = r.withColumn("_k", F.col("_r") <= F.greatest(reject * F.col("_m"), F.lit(keep_within)))
        enough = F.count_if("_k").over(own) >= least
        o = r.select(*o.columns[:-1], F.when(enough & F.col("_k").isNotNull(), F.col("_k")).otherwise(used).alias("used"))
    fit = fitted(o).groupBy("volume_id").agg(*[F.first(c).alias(c) for c in _FIT], F.max(size(turn)).alias("max_shift"), F.count_if(~used).alias("rejected"))
    tail = F.pandas_udf(_p_value, "double")
    p = F.when(F.col("f_stat").isNotNull(), tail(F.coalesce("f_stat", F.lit(0.0)), "dof"))
    f = fit.select("volume_id", *_FIT, p.alias("p"), "max_shift", "rejected")
    status = F.when(F.col("p").isNull() | (F.col("p") >= p_limit), "not_significant").when(F.col("r2") < r2_limit, "not_explained")
    return f.withColumn("status", status.when(F.col("max_shift") < 0.5 * voxel, "unresolved").otherwise("active"))


def radial_offsets(offsets: DataFrame, axis: tuple[float, float, float] = (0.0, 0.0, 1.0), least: int = 3) -> DataFrame:
    """Median offset along Q over |Q| by |Q| band (4 Å⁻¹ wide, open from 16) and direction from a unit axis."""
    q, d = [F.col(f"q{a}") for a in "xyz"], [F.col(f"d{a}") for a in "xyz"]
    q2 = q[0] * q[0] + q[1] * q[1] + q[2] * q[2]
    along = q[0] * axis[0] + q[1] * axis[1] + q[2] * axis[2]
    cos2 = along * along / q2
    way = F.when(cos2 < 0.05, "in-plane").when(cos2 < 0.7, "oblique").otherwise("near the third axis")
    o = offsets.filter(q2 > 0).select("volume_id", F.least(F.floor(F.sqrt(q2) / 4), F.lit(4)).cast("int").alias("band"), way.alias("direction"), ((d[0] * q[0] + d[1] * q[1] + d[2] * q[2]) / q2).alias("_o"))
    return o.groupBy("volume_id", "band", "direction").agg(F.count("*").alias("n"), F.expr("percentile(_o, 0.5)").alias("offset")).filter(F.col("n") >= least)


def mean_offsets(centres: DataFrame) -> DataFrame:
    """Mean of centre − node in lattice units and its standard error; centres: (volume_id, ch, ck, cl, nh, nk, nl)."""
    e = [F.col(f"c{a}") - F.col(f"n{a}") for a in "hkl"]
    return centres.groupBy("volume_id").agg(
        F.count("*").alias("n"), *[F.avg(x).alias(f"mean_{a}") for x, a in zip(e, "hkl", strict=True)],
        *[(F.stddev_samp(x) / F.sqrt(F.count("*"))).alias(f"error_{a}") for x, a in zip(e, "hkl", strict=True)],
    )


def _turn(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The proper rotation that carries b onto a best."""
    u, _, v = np.linalg.svd(a.T @ (w[:, None] * b))
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v))]) @ v


def ub_fit(centres: DataFrame, kind: str = "orientation", reject: float = 3.0, keep_within: float = 0.0) -> DataFrame:
    """The UB that puts measured centres on their nodes, per volume, with outliers left out (at most five rounds).

    centres: (volume_id, ub, ch, ck, cl, nh, nk, nl, w), the centres in the lattice units of ``ub``.  ``orientation``
    turns the given UB, ``both`` also fits the cell (triclinic least squares), ``lattice`` fits the cell and keeps
    the orientation.  A group is one volume's nodes, which its box bounds, not the data.  Volumes with fewer than
    three centres are returned with a null UB.  Rows with a null are left out.
    """
    if kind not in ("orientation", "both", "lattice"):
        raise ValueError(f"unknown fit {kind!r}")

    def fit(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        g = groups.dropna()
        name = groups["volume_id"].iloc[0]
        if len(g) < 3:
            return pd.DataFrame([{"volume_id": name, "fitted": None, "n": len(g), "used": 0, "rms": None, "angle": None}])
        start = np.array(list(g["ub"].iloc[0]), dtype=float).reshape(3, 3)
        node, w = g[["nh", "nk", "nl"]].to_numpy(float), g["w"].to_numpy(float)
        at = g[["ch", "ck", "cl"]].to_numpy(float) @ start.T
        used = np.ones(len(g), dtype=bool)
        for _ in range(6):
            n, q, s = node[used], at[used], w[used][:, None]
            if kind == "orientation":
                ub = _turn(q, n @ start.T, w[used]) @ start
            else:
                ub = np.linalg.lstsq(np.sqrt(s) * n, np.sqrt(s) * q, rcond=None)[0].T
                if kind == "lattice":  # the fitted cell in the orientation of the start
                    u, _, v = np.linalg.svd(ub @ np.linalg.inv(start))
                    ub = (u @ v).T @ ub
            miss = np.linalg.norm(at - node @ ub.T, axis=1)
            kept = miss <= max(reject * np.median(miss[used]), keep_within)
            if kept.sum() < 3 or (kept == used).all():
                break
            used = kept
        u, _, v = np.linalg.svd(ub @ np.linalg.inv(start))
        angle = math.degrees(math.acos(max(-1.0, min(1.0, (np.trace(u @ v) - 1) / 2))))
        return pd.DataFrame([{"volume_id": name, "fitted": ub.ravel().tolist(), "n": len(g), "used": int(used.sum()), "rms": float(np.sqrt(np.mean(miss[used] ** 2))), "angle": angle}])

    columns = centres.select("volume_id", "ub", *[f"c{a}" for a in "hkl"], *[f"n{a}" for a in "hkl"], "w")
    return columns.groupBy("volume_id").applyInPandas(fit, "volume_id string, fitted array<double>, n int, used int, rms double, angle double")


def lattice_points(axes: DataFrame, origin: bool = False) -> DataFrame:
    """The grid points nearest every whole (u, v, w) inside a map: axes (volume_id, axis h/k/l, idx, value).

    Per axis each whole number in range takes its nearest index (the lower of two); the three lists are joined.
    """
    ends = axes.groupBy("volume_id", "axis").agg(F.ceil(F.min("value")).alias("_lo"), F.floor(F.max("value")).alias("_hi")).filter("_lo <= _hi")
    whole = ends.select("volume_id", "axis", F.explode(F.expr("sequence(cast(_lo as int), cast(_hi as int))")).alias("u"))
    near = whole.join(axes, ["volume_id", "axis"]).groupBy("volume_id", "axis", "u").agg(F.min(F.struct(F.abs(F.col("value") - F.col("u")).alias("d"), "idx")).alias("_m"))
    one = lambda a: near.filter(F.col("axis") == a).select("volume_id", F.col("u").alias(f"u{a}"), F.col("_m.idx").alias(f"i{a}"))
    p = one("h").join(one("k"), "volume_id").join(one("l"), "volume_id")
    return p if origin else p.filter("not (uh = 0 and uk = 0 and ul = 0)")


def applied_symmetry(volumes: DataFrame, explicit: DataFrame, declared: DataFrame, raw: DataFrame) -> DataFrame:
    """The symmetry of each volume (volume_id, ignored): explicit operations, else what its file, else what its raw input declares.

    The others are (volume_id, symmetry), a null symmetry declares nothing.  None where it is ignored.
    """
    v = volumes
    for name, t in (("explicit", explicit), ("file", declared), ("raw", raw)):
        v = v.join(t.filter("symmetry is not null").groupBy("volume_id").agg(F.min("symmetry").alias(f"_{name}")), "volume_id", "left")
    ignored = F.coalesce("ignored", F.lit(False))
    source = F.when(ignored, F.lit("ignored")).when(F.col("_explicit").isNotNull(), "explicit").when(F.col("_file").isNotNull(), "file").when(F.col("_raw").isNotNull(), "raw")
    return v.select("volume_id", F.when(~ignored, F.coalesce("_explicit", "_file", "_raw")).alias("symmetry"), source.alias("source"))


def plane_protected(bins: DataFrame, centres: Sequence[float], fractions: Sequence[float], half: float, ops: Sequence[Matrix]) -> DataFrame:
    """bins with ``protected``: within half of h = centre or h ≡ fraction (mod 1), or of a plane equivalent by ops."""
    if half <= 0 or not (centres or fractions):
        return bins.withColumn("protected", F.lit(False))
    near = F.lit(False)
    for row in dict.fromkeys(m[:3] for m in closed(ops)):  # the images of h under the group and its inverses, which it holds
        x = row[0] * F.col("h") + row[1] * F.col("k") + row[2] * F.col("l")
        for c in centres:
            near = near | (F.abs(x - c) <= half)
        for f in fractions:
            near = near | (F.abs(F.pmod(x - f + 0.5, F.lit(1.0)) - 0.5) <= half)
    return bins.withColumn("protected", near)


def pair_sections(differences: DataFrame, lengths: tuple[float, float, float], cut: float, depth: float, reach: float, key: Sequence[str] = ()) -> DataFrame:
    """Pair vectors (Å) within ``depth`` of the plane z = cut and ``reach`` of its centre on x and y; counts of equal ones.

    differences: (key…, site, site2, x, y, z) in [0, 1).  The zero vector is left out.
    """
    d = differences
    for a, n, lo, hi in zip("xyz", lengths, (-reach, -reach, cut - depth), (reach, reach, cut + depth), strict=True):
        first, last = F.ceil(lo / n - F.col(a) - 1e-9), F.floor(hi / n - F.col(a) + 1e-9)
        d = d.withColumn("_t", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn(a, (F.col(a) + F.col("_t")) * n).drop("_t")
    d = d.filter("not (abs(x) < 1e-6 and abs(y) < 1e-6 and abs(z) < 1e-6)")
    return d.groupBy(*key, *[F.round(a, 3).alias(a) for a in "xyz"]).agg(F.count("*").alias("n")).withColumn("off", F.round(F.col("z") - cut, 3))


def signal_counts(values: DataFrame, threshold: float, key: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Pair vectors by their value in σ: at or over the threshold, at or under its negative, between, and without value."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return values.groupBy(*key).agg(
        F.count_if(v >= threshold).alias("positive"), F.count_if(v <= -threshold).alias("negative"),
        F.count_if(F.abs(v) < threshold).alias("quiet"), F.count_if(v.isNull()).alias("no_value"),
    )
