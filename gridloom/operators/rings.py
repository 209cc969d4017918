"""Powder rings: line lists, matches of rings to lines, direction cells, and the isotropy verdict."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizes import bounded
from .filters import measured


def cubic_lines(spark: SparkSession, a: float, q_max: float, centring: str = "F") -> DataFrame:
    """Line positions and multiplicities of a cubic lattice up to q_max: (n = h² + k² + l², q, multiplicity)."""
    m = int(q_max * a / (2 * math.pi)) + 1
    g = spark.range(1)
    for x in "hkl":
        g = g.withColumn(x, F.explode(F.sequence(F.lit(-m), F.lit(m))))
    same = (F.col("h") % 2 == 0) & (F.col("k") % 2 == 0) & (F.col("l") % 2 == 0) | (F.col("h") % 2 != 0) & (F.col("k") % 2 != 0) & (F.col("l") % 2 != 0)
    keep = {"F": same, "I": (F.col("h") + F.col("k") + F.col("l")) % 2 == 0, "P": F.lit(True)}[centring]
    n = F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l")
    g = g.withColumn("n", n).filter(keep & (F.col("n") > 0)).groupBy("n").agg(F.count("*").alias("multiplicity"))
    return g.withColumn("q", 2 * math.pi / a * F.sqrt("n")).filter(F.col("q") <= q_max)


def cubic_lines_of(cells: DataFrame, q_max: float, centring: str = "F") -> DataFrame:
    """:func:`cubic_lines` of each cell (volume_id, a); equal lattice constants share one list."""
    sides = cells.filter("a > 0").select("a").distinct()
    m = F.floor(q_max * F.col("a") / (2 * math.pi)).cast("int")
    for x in "hkl":
        sides = sides.withColumn(x, F.explode(F.sequence(-m, m)))
    h, k, l = (F.abs(x) % 2 for x in "hkl")
    keep = {"F": (h == k) & (k == l), "I": (h + k + l) % 2 == 0, "P": F.lit(True)}[centring]
    n = (F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l")).cast("long")
    lines = sides.withColumn("n", n).filter(keep & (F.col("n") > 0)).groupBy("a", "n").agg(F.count("*").alias("multiplicity"))
    lines = lines.withColumn("q", 2 * math.pi / F.col("a") * F.sqrt("n")).filter(F.col("q") <= q_max)
    return cells.select("volume_id", "a").join(lines, "a").select("volume_id", "n", "multiplicity", "q")


def powder_lines(reflections: DataFrame, atoms: DataFrame, volume: float, key: str | None = None) -> DataFrame:
    """Intensity of each reflection: |F|² / (V²·Q²) from atoms (x, y, z, weight) of the cell; absences are left out.

    Without ``key`` the atom table is one cell's (bounded, checked); with it, reflections and atoms meet within their
    structure, sorted on both sides: neither is broadcast.  Reflections without the ``key`` column are those of every
    structure (:func:`_common_lines`).  Each reflection sums over its atoms in a combined group-by.
    """
    if key and key not in reflections.columns:
        return _common_lines(reflections, atoms, volume, key)
    own = [key] if key else []
    phase = 2 * math.pi * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    j = (reflections.join(atoms.hint("merge"), key) if key else reflections.join(bounded(atoms))).withColumn("_p", phase)
    g = j.groupBy(*own, "h", "k", "l", "q").agg(F.sum(F.col("weight") * F.cos("_p")).alias("re"), F.sum(F.col("weight") * F.sin("_p")).alias("im"), F.sum(F.abs("weight")).alias("all"))
    f2 = F.col("re") ** 2 + F.col("im") ** 2
    g = g.withColumn("f2", f2).filter(F.col("f2") > 1e-8 * F.col("all") ** 2)
    return g.select(*own, "h", "k", "l", "q", "f2", (F.col("f2") / (volume**2 * F.col("q") ** 2)).alias("intensity"))


#: Reflections up to which one list serves all structures.
MOST_REFLECTIONS = 20_000


def _common_lines(reflections: DataFrame, atoms: DataFrame, volume: float, key: str) -> DataFrame:
    """:func:`powder_lines` of one bounded list of reflections over many structures.

    The atoms come sorted by structure, one shuffle, and their terms are added up as they pass; the sums of a structure
    that goes on in the next batch are carried over, so memory depends neither on the structures nor on their atoms.
    """
    rows = reflections.select("h", "k", "l", "q").limit(MOST_REFLECTIONS + 1).collect()
    if len(rows) > MOST_REFLECTIONS:
        raise ValueError(f"a common list of reflections has over {MOST_REFLECTIONS} rows")
    hkl, q = np.array([r[:3] for r in rows], dtype=float).reshape(-1, 3).T, np.array([r[3] for r in rows], dtype=float)
    most = max(1, 2_000_000 // max(1, len(rows)))

    def finished(names: np.ndarray, re: np.ndarray, im: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        f2 = re**2 + im**2
        s, i = np.nonzero(f2 > 1e-8 * (total**2)[:, None])
        out = {key: names[s], **{a: hkl[j, i] for j, a in enumerate("hkl")}, "q": q[i], "f2": f2[s, i], "intensity": f2[s, i] / (volume**2 * q[i] ** 2)}
        return pd.DataFrame(out).astype({a: np.int64 for a in "hkl"})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sums = None, ()
        for batch in batches:
            for at in range(0, len(batch), most):
                g = batch.iloc[at : at + most]
                own, w = g[key].to_numpy(), g["_w"].to_numpy()[:, None]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                phase = 2 * np.pi * (g[["x", "y", "z"]].to_numpy() @ hkl)
                new = [np.add.reduceat(t, first) for t in (w * np.cos(phase), w * np.sin(phase), g["_all"].to_numpy())]
                if names is not None and names[0] == own[0]:
                    for n, s in zip(new, sums, strict=True):
                        n[0] += s[0]
                elif names is not None:
                    yield finished(names, *sums)
                names = own[first]
                if len(names) > 1:
                    yield finished(names[:-1], *[n[:-1] for n in new])
                names, sums = names[-1:], [n[-1:] for n in new]
        if names is not None:
            yield finished(names, *sums)

    known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & F.col("weight").isNotNull()
    one = lambda c: F.when(known, F.col(c)).otherwise(0.0).cast("double")
    a = atoms.filter(F.col(key).isNotNull()).select(key, *[one(c).alias(c) for c in "xyz"], one("weight").alias("_w"), F.coalesce(F.abs("weight"), F.lit(0.0)).cast("double").alias("_all"))
    kind = atoms.schema[key].dataType.simpleString()
    lines = a.repartition(key).sortWithinPartitions(key).mapInPandas(summed, f"`{key}` {kind}, h bigint, k bigint, l bigint, q double, f2 double, intensity double")
    return lines.select(key, *[F.col(c).cast(reflections.schema[c].dataType).alias(c) for c in "hkl"], "q", "f2", "intensity")


def matched(rings: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """Each ring (volume_id, q) with its nearest line within a tolerance, or null."""
    l = bounded(lines.select(F.col("q").alias("line_q"), F.col("n").alias("line")))
    d = F.abs(F.col("q") - F.col("line_q"))
    near = rings.join(l, d <= tolerance).groupBy("volume_id", "q").agg(F.min(F.struct(d.alias("d"), "line")).alias("_m"))
    return rings.join(near, ["volume_id", "q"], "left").select(*rings.columns, F.col("_m.line").alias("line"), F.col("_m.d").alias("distance"))


def direction_cell(x: Column, y: Column, z: Column, q: Column, n_cos: int, n_phi: int) -> Column:
    """Index of the cosθ × φ cell of a direction."""
    c = F.least(F.floor((F.greatest(F.least(z / q, F.lit(1.0)), F.lit(-1.0)) + 1) / 2 * n_cos), F.lit(n_cos - 1))
    p = F.pmod(F.floor((F.atan2(y, x) + math.pi) / (2 * math.pi) * n_phi), F.lit(n_phi))
    return (c * n_phi + p).cast("int")


def cell_heights(bins: DataFrame, ub: tuple[float, ...], windows: DataFrame, n_cos: int = 2, n_phi: int = 4) -> DataFrame:
    """Height of each ring in each direction cell over the line through its two flanks.

    windows: (window_id, lo, hi, role) with role core or flank; a small table, checked when hinted.
    """
    from ..functions.geometry import q_vector

    v = q_vector(ub, F.col("h"), F.col("k"), F.col("l"))
    b = bins.filter(measured() & (F.col("q") > 0)).withColumn("cell", direction_cell(*v, F.col("q"), n_cos, n_phi))
    j = b.select("volume_id", "cell", "q", "intensity").join(bounded(windows), (F.col("q") >= F.col("lo")) & (F.col("q") < F.col("hi")))
    f, c = F.col("role") == "flank", F.col("role") == "core"
    g = j.groupBy("volume_id", "window_id", "cell").agg(
        F.regr_slope(F.when(f, F.col("intensity")), F.when(f, F.col("q"))).alias("slope"), F.regr_intercept(F.when(f, F.col("intensity")), F.when(f, F.col("q"))).alias("base"),
        F.avg(F.when(c, F.col("intensity"))).alias("core"), F.avg(F.when(c, F.col("q"))).alias("cq"), F.count(F.when(c, 1)).alias("n_core"), F.count(F.when(f, 1)).alias("n_flank"),
    )
    return g.withColumn("height", F.col("core") - (F.col("base") + F.col("slope") * F.col("cq")))


def isotropy(heights: DataFrame, share: float = 0.9, height: float = 0.15, cells: int = 16) -> DataFrame:
    """Verdict per ring: a ring rises in nearly every direction; null (not judged) under ``cells`` measured cells."""
    m = heights.filter("height is not null").groupBy("volume_id", "window_id").agg(F.expr("percentile(height, 0.5)").alias("median"), F.expr(f"percentile(height, {1 - share})").alias("low"), F.count("*").alias("n"))
    return m.withColumn("isotropic", F.when(F.col("n") >= cells, (F.col("median") > 0) & (F.col("low") >= height * F.col("median"))))


def profile_peaks(profile: DataFrame, share: float = 0.06) -> DataFrame:
    """Local maxima of a profile (volume_id, shell, value) that rise above a share of the strongest, with half-height width in shells."""
    w = Window.partitionBy("volume_id").orderBy("shell")
    p = profile.withColumn("_a", F.lag("value").over(w)).withColumn("_b", F.lead("value").over(w)).withColumn("_t", F.max("value").over(Window.partitionBy("volume_id")))
    top = p.filter((F.col("value") > F.coalesce("_a", F.lit(float("-inf")))) & (F.col("value") >= F.coalesce("_b", F.lit(float("-inf")))) & (F.col("value") > share * F.col("_t")) & (F.col("value") > 0))
    top = top.select("volume_id", F.col("shell").alias("top"), F.col("value").alias("height"))
    j = top.join(profile, "volume_id").filter("value < height / 2")
    left, right = F.max(F.when(F.col("shell") < F.col("top"), F.col("shell"))), F.min(F.when(F.col("shell") > F.col("top"), F.col("shell")))
    g = j.groupBy("volume_id", "top", "height").agg((right - left - 1).alias("width"))
    return top.join(g, ["volume_id", "top", "height"], "left")
