"""Peaks: windows about them, node tests, moments, rotation-free offsets, and the holes a punch leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import hinted
from .filters import measured

BINKEY = ["volume_id", "ih", "ik", "il"]


def windows(peaks: DataFrame, bins: DataFrame, radius: int) -> DataFrame:
    """Measured bins of the box about each peak: (volume_id, peak_id, dh, dk, dl, d2, intensity, sigma).

    Peaks explode their box of integer offsets, then one equi-join reads the bins.
    """
    r = range(-radius, radius + 1)
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in r for b in r for c in r])
    p = peaks.select("volume_id", "peak_id", "ih", "ik", "il", F.explode(o).alias("_o")).select(
        "volume_id", "peak_id", *[F.col(f"_o.{x}").alias(f"d{a}") for a, x in zip("hkl", "abc", strict=True)],
        *[(F.col(f"i{a}") + F.col(f"_o.{x}")).alias(f"i{a}") for a, x in zip("hkl", "abc", strict=True)],
    )
    j = p.join(bins.filter(measured()).select(*BINKEY, "intensity", "sigma"), BINKEY)
    return j.withColumn("d2", F.col("dh") ** 2 + F.col("dk") ** 2 + F.col("dl") ** 2)


def numbered(peaks: DataFrame, order: Sequence[str] = ("ih", "ik", "il")) -> DataFrame:
    """peaks with ``peak_id``: the number within its volume in index order."""
    return peaks.withColumn("peak_id", F.row_number().over(Window.partitionBy("volume_id").orderBy(*order)))


def significance(peaks: DataFrame, bins: DataFrame, core: int = 1, least: int = 8) -> DataFrame:
    """z of each peak: excess of its core over the median of the shell around it, over the root of the summed σ².

    Null where the shell has fewer than ``least`` measured bins (not judged).
    """
    w = windows(peaks, bins, 2 * core)
    inner, outer = F.col("d2") <= core**2, (F.col("d2") > core**2) & (F.col("d2") <= (2 * core) ** 2)
    bg = w.groupBy("volume_id", "peak_id").agg(F.expr(f"percentile(case when d2 > {core**2} and d2 <= {4 * core**2} then intensity end, 0.5)").alias("bg"), F.count(F.when(outer, 1)).alias("n"))
    j = w.filter(inner).join(hinted(bg), ["volume_id", "peak_id"])
    g = j.groupBy("volume_id", "peak_id").agg(
        (F.sum(F.col("intensity") - F.col("bg")) / F.sqrt(F.sum(F.col("sigma") ** 2))).alias("z"), F.max("bg").alias("background"), F.max("n").alias("n")
    )
    return g.withColumn("z", F.when((F.col("n") >= least) & ~F.isnan("z"), F.col("z")))


def broad_share(peaks: DataFrame, bins: DataFrame) -> DataFrame:
    """Share of a core's excess that is left in the near shell: (near − far) / (core − far); large for broad humps."""
    w = windows(peaks, bins, 4)
    part = lambda lo, hi: f"percentile(case when d2 > {lo} and d2 <= {hi} then intensity end, 0.5)"
    g = w.groupBy("volume_id", "peak_id").agg(
        F.avg(F.when(F.col("d2") <= 1, F.col("intensity"))).alias("core"), F.expr(part(1, 4)).alias("near"), F.expr(part(9, 16)).alias("far")
    )
    return g.withColumn("share", F.when(F.col("core") != F.col("far"), (F.col("near") - F.col("far")) / (F.col("core") - F.col("far"))))


def moments(peaks: DataFrame, bins: DataFrame, radius: int = 1) -> DataFrame:
    """Weighted centroid and covariance of each peak's core over its least value, in bins."""
    w = windows(peaks, bins, radius)
    low = w.groupBy("volume_id", "peak_id").agg(F.min("intensity").alias("_m"))
    w = w.join(hinted(low), ["volume_id", "peak_id"]).withColumn("w", F.col("intensity") - F.col("_m"))
    s = lambda e: F.sum(F.col("w") * e)
    g = w.groupBy("volume_id", "peak_id").agg(
        F.sum("w").alias("total"), *[s(F.col(f"d{a}")).alias(f"s{a}") for a in "hkl"],
        *[s(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"s{a}{b}") for a, b in ("hh", "kk", "ll", "hk", "hl", "kl")],
    ).filter("total > 0")
    out = [F.col(c) for c in ("volume_id", "peak_id", "total")]
    out += [(F.col(f"s{a}") / F.col("total")).alias(f"c{a}") for a in "hkl"]
    out += [(F.col(f"s{a}{b}") / F.col("total") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("total") ** 2).alias(f"v{a}{b}") for a, b in ("hh", "kk", "ll", "hk", "hl", "kl")]
    return g.select(*out)


def node_centres(bins: DataFrame, step: float, half: float = 0.3, radius: int = 1) -> DataFrame:
    """Centroid of each node's brightest bin over its least neighbour: (volume_id, nh, nk, nl, ih, ik, il, oh, ok, ol).

    The same as :func:`lattice.nodes`, :func:`lattice.node_peaks` and :func:`moments` of the box of ``radius`` bins, on a
    parent lattice of whole indices: oh, ok, ol are the centroid's offsets from the brightest bin, in bins.  A box that
    starts within ``half`` of a node and stays nearer to it than to any other needs the bins of that node only, so one
    shuffle by node serves every step; a group is a node's own bins.
    """
    if half + radius * step > 0.5 + 1e-9:
        raise ValueError("the boxes reach beyond the nodes' own cells")
    key = ["volume_id", "nh", "nk", "nl"]
    b = bins.filter(measured()).select("volume_id", *[F.rint(a).cast("int").alias(f"n{a}") for a in "hkl"], *BINKEY[1:], "h", "k", "l", "intensity")
    b = b.filter("not (nh = 0 and nk = 0 and nl = 0)")
    inside = F.lit(True)
    for a in "hkl":
        inside = inside & (F.abs(F.col(a) - F.col(f"n{a}")) <= half)
    own = Window.partitionBy(*key)
    top = F.max(F.when(inside, F.struct("intensity", *[(-F.col(f"i{a}")).alias(a) for a in "hkl"]))).over(own)
    b = b.withColumn("_t", top).select(*key, *[(-F.col(f"_t.{a}")).alias(f"i{a}") for a in "hkl"], *[(F.col(f"i{a}") + F.col(f"_t.{a}")).alias(f"d{a}") for a in "hkl"], "intensity")
    for a in "hkl":
        b = b.filter(F.abs(f"d{a}") <= radius)
    b = b.withColumn("w", F.col("intensity") - F.min("intensity").over(own))
    g = b.groupBy(*key).agg(*[F.first(f"i{a}").alias(f"i{a}") for a in "hkl"], F.sum("w").alias("_w"), *[F.sum(F.col("w") * F.col(f"d{a}")).alias(f"_{a}") for a in "hkl"])
    return g.filter("_w > 0").select(*key, *BINKEY[1:], *[(F.col(f"_{a}") / F.col("_w")).alias(f"o{a}") for a in "hkl"])


def claimed(peaks: DataFrame, half: float = 0.3) -> DataFrame:
    """Search peaks claimed by their nearest node inside its window; the brightest of a node wins."""
    p = peaks
    inside = F.lit(True)
    for a in "hkl":
        p = p.withColumn(f"n{a}", F.rint(a).cast("int"))
        inside = inside & (F.abs(F.col(a) - F.col(f"n{a}")) <= half)
    w = Window.partitionBy("volume_id", "nh", "nk", "nl").orderBy(F.col("value").desc(), "ih", "ik", "il")
    return p.filter(inside).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def parabola(extrema: DataFrame, bins: DataFrame) -> DataFrame:
    """Sub-bin place of each extremum along each axis from its two neighbours, clipped to half a bin."""
    w = windows(numbered(extrema), bins, 1).filter("abs(dh) + abs(dk) + abs(dl) <= 1")
    at = lambda a, d: F.max(F.when((F.col(f"d{a}") == d) & (F.col("d2") == abs(d)), F.col("intensity")))
    g = w.groupBy("volume_id", "peak_id").agg(*[at(a, d).alias(f"{a}{d + 1}") for a in "hkl" for d in (-1, 0, 1)])
    out = []
    for a in "hkl":
        lo, mid, hi = (F.col(f"{a}{d}") for d in range(3))
        bend = lo - 2 * mid + hi
        x = F.when(bend != 0, 0.5 * (lo - hi) / bend).otherwise(0.0)
        out.append(F.coalesce(F.least(F.greatest(x, F.lit(-0.5)), F.lit(0.5)), F.lit(0.0)).alias(f"o{a}"))
    return g.select("volume_id", "peak_id", *out)


def fill_bias(holes: DataFrame, least: int = 5, sigma: float = 0.5, floor: float = 0.2, one_way: float = 0.75) -> DataFrame:
    """Verdict per volume over holes (bias_sigma, bias_level): systematic, or null where there are too few holes."""
    g = holes.groupBy("volume_id").agg(
        F.count("*").alias("n"), F.expr("percentile(bias_sigma, 0.5)").alias("ms"), F.expr("percentile(bias_level, 0.5)").alias("ml"),
        F.greatest(F.avg((F.col("bias_sigma") > 0).cast("int")), F.avg((F.col("bias_sigma") < 0).cast("int"))).alias("way"),
    )
    hit = (F.abs("ms") >= sigma) & (F.abs("ml") >= floor) & (F.col("way") >= one_way)
    return g.select("volume_id", "n", "ms", "ml", "way", F.when(F.col("n") >= least, hit).alias("systematic"))
