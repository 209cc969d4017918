"""Neighbourhoods, connected regions, symmetry orbits, and what is filled from them.

All neighbour reads are equi-joins on integer indices: the sparse side explodes fixed offsets.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import hinted
from .filters import measured

BINKEY = ["volume_id", "ih", "ik", "il"]


def saved(df: DataFrame) -> DataFrame:
    """df written to the folder of the session's ``spark.checkpoint.dir``, its lineage cut.

    A session of one machine that sets none, as in tests, gets a temporary folder; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def offsets(df: DataFrame, radius: int, faces: bool = False, self_too: bool = True) -> DataFrame:
    """df with a row for each bin of the (2·radius + 1)³ box about each bin, or of its six faces only; radius ≤ 4."""
    if radius > 4:
        raise ValueError("a neighbourhood of more than 4 bins is refused")
    r = range(-radius, radius + 1)
    near = [(a, b, c) for a in r for b in r for c in r if (self_too or (a, b, c) != (0, 0, 0)) and (not faces or abs(a) + abs(b) + abs(c) <= 1)]
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in near])
    d = df.withColumn("_o", F.explode(o))
    return d.withColumn("nh", F.col("ih") + F.col("_o.a")).withColumn("nk", F.col("ik") + F.col("_o.b")).withColumn("nl", F.col("il") + F.col("_o.c")).drop("_o")


def grid(volumes: DataFrame) -> DataFrame:
    """Every bin of every volume's grid."""
    g = volumes.select("volume_id", "nh", "nk", "nl", F.explode(F.expr("sequence(0, nh - 1)")).alias("ih"))
    return g.withColumn("ik", F.explode(F.expr("sequence(0, nk - 1)"))).withColumn("il", F.explode(F.expr("sequence(0, nl - 1)")))


def unmeasured(bins: DataFrame, volumes: DataFrame) -> DataFrame:
    """Bins of the grid that are absent or not measured."""
    return grid(volumes).join(bins.filter(measured()).select(*BINKEY), BINKEY, "left_anti").select(*BINKEY, "nh", "nk", "nl")


def trim_edge(bins: DataFrame, volumes: DataFrame, radius: int = 1) -> DataFrame:
    """Measured bins within radius (Chebyshev) of an unmeasured one become unmeasured; box faces are no edge."""
    near = offsets(unmeasured(bins, volumes).select(*BINKEY), radius).select("volume_id", F.col("nh").alias("ih"), F.col("nk").alias("ik"), F.col("nl").alias("il"))
    near = near.distinct().withColumn("_edge", F.lit(True))
    return bins.join(near, BINKEY, "left").withColumn("measured", F.col("measured") & F.col("_edge").isNull()).drop("_edge")


def local_extrema(bins: DataFrame, sign: int = 1) -> DataFrame:
    """Measured bins that are the largest (sign 1) or least (sign −1) of the measured bins of their 3×3×3 box."""
    b = bins.filter(measured()).select(*BINKEY, (sign * F.col("intensity")).alias("v"))
    near = offsets(b, 1, self_too=False).groupBy("volume_id", "nh", "nk", "nl").agg(F.max("v").alias("_top"))
    near = near.select("volume_id", F.col("nh").alias("ih"), F.col("nk").alias("ik"), F.col("nl").alias("il"), "_top")
    return b.join(near, BINKEY, "left").filter("_top is null or v >= _top").select(*BINKEY, (sign * F.col("v")).alias("value"))


def components(mask: DataFrame, faces: bool = True) -> DataFrame:
    """mask (bins of regions) with ``region``: the least flat index (ih, ik, il) it is connected to, as a string-free triple.

    Labels start as packed indices; rounds take the least label of the neighbours, then follow labels one hop
    (pointer jumping), until no label changes.  Neighbour pairs are made once; each round is written out.
    """
    pack = lambda a, b, c: (F.col(a).cast("long") * 2**42 + F.col(b).cast("long") * 2**21 + F.col(c)).cast("long")
    nodes = mask.select(*BINKEY).distinct().withColumn("node", pack("ih", "ik", "il"))
    pairs = offsets(nodes, 1, faces=faces, self_too=False).select("volume_id", "node", pack("nh", "nk", "nl").alias("b"))
    pairs = saved(pairs.join(nodes.select("volume_id", F.col("node").alias("b")), ["volume_id", "b"]))
    label = saved(nodes.select("volume_id", "node", F.col("node").alias("label")))
    while True:
        near = pairs.join(label.select("volume_id", F.col("node").alias("b"), F.col("label").alias("x")), ["volume_id", "b"])
        near = near.groupBy("volume_id", "node").agg(F.min("x").alias("x"))
        new = label.join(near, ["volume_id", "node"], "left").select("volume_id", "node", "label", F.least("label", "x").alias("x"))
        hop = new.select("volume_id", F.col("node").alias("x"), F.col("x").alias("y"))
        new = saved(new.join(hop, ["volume_id", "x"], "left").select("volume_id", "node", "label", F.coalesce(F.least("x", "y"), "x").alias("new")))
        if new.filter("new <> label").limit(1).count() == 0:
            break
        label = new.select("volume_id", "node", F.col("new").alias("label"))
    done = new.select("volume_id", "node", F.col("new").alias("region"))
    return nodes.join(done, ["volume_id", "node"]).drop("node")


def region_census(regions: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Size and bounding box of each region."""
    return regions.groupBy("volume_id", "region").agg(
        F.count("*").alias("n"), *[f(f"i{a}").alias(f"{name}_{a}") for a in "hkl" for name, f in (("lo", F.min), ("hi", F.max))]
    )


def hole_census(regions: DataFrame, volumes: DataFrame, large: tuple[int, ...] = (2_000, 10_000)) -> DataFrame:
    """Per volume: number of regions, their bins and share of the grid, size percentiles, share of the bins in regions over each limit."""
    n = F.col("n")
    g = region_census(regions).groupBy("volume_id").agg(
        F.count("*").alias("n_holes"), F.sum(n).alias("n_bins"), *[F.expr(f"percentile(n, {p / 100})").alias(f"size_p{p}") for p in (50, 90, 99, 100)],
        *[(F.sum(F.when(n > x, n).otherwise(0)) / F.sum(n)).alias(f"share_over_{x}") for x in large],
    )
    size = hinted(volumes.select("volume_id", (F.col("nh") * F.col("nk") * F.col("nl")).alias("_all")))
    return g.join(size, "volume_id").withColumn("share_of_grid", F.col("n_bins") / F.col("_all")).drop("_all")


def largest_holes(regions: DataFrame, volumes: DataFrame, top: int = 5) -> DataFrame:
    """The largest regions of each volume (the least label first on a tie) with their centres h, k, l."""
    g = regions.groupBy("volume_id", "region").agg(F.count("*").alias("n"), *[F.avg(f"i{a}").alias(f"_{a}") for a in "hkl"])
    w = Window.partitionBy("volume_id").orderBy(F.desc("n"), "region")
    g = g.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    axes = hinted(volumes.select("volume_id", *[f"{a}0" for a in "hkl"], *[f"d{a}" for a in "hkl"]))
    at = [(F.col(f"{a}0") + F.col(f"_{a}") * F.col(f"d{a}")).alias(a) for a in "hkl"]
    return g.join(axes, "volume_id").select("volume_id", "place", "region", "n", *at)


def enclosed(bins: DataFrame, volumes: DataFrame) -> DataFrame:
    """Unmeasured bins with ``open``: whether their region touches a face of the box."""
    u = unmeasured(bins, volumes)
    face = F.greatest(*[F.when((F.col(f"i{a}") == 0) | (F.col(f"i{a}") == F.col(f"n{a}") - 1), 1).otherwise(0) for a in "hkl"])
    r = components(u).join(u.select(*BINKEY, face.alias("_f")), BINKEY)
    touch = r.groupBy("volume_id", "region").agg(F.max("_f").alias("_t"))
    return r.join(touch, ["volume_id", "region"]).select(*BINKEY, "region", (F.col("_t") == 1).alias("open"))


# --- symmetry: operations are integer 3×3 matrices about the middle bin -----------------------------------

#: Operations of the point group mmm (all sign changes), row-major.
MMM = tuple((a, 0, 0, 0, b, 0, 0, 0, c) for a in (1, -1) for b in (1, -1) for c in (1, -1))
#: Operations of 4/mmm.
FOUR_MMM = MMM + tuple((0, a, 0, b, 0, 0, 0, 0, c) for a in (1, -1) for b in (1, -1) for c in (1, -1))


def images(bins: DataFrame, volumes: DataFrame, ops: tuple[tuple[int, ...], ...]) -> DataFrame:
    """bins with a row for each operation: op and the image's indices (gh, gk, gl); images off the grid are left out."""
    o = F.array(*[F.struct(F.lit(i).alias("op"), F.array(*[F.lit(x) for x in m]).alias("m")) for i, m in enumerate(ops)])
    size = hinted(volumes.select("volume_id", "nh", "nk", "nl"))
    d = bins.join(size, "volume_id").withColumn("_o", F.explode(o))
    c = {a: F.col(f"i{a}") - F.floor(F.col(f"n{a}") / 2) for a in "hkl"}
    for r, a in enumerate("hkl"):
        x = sum((F.col("_o.m")[3 * r + j] * c[b] for j, b in enumerate("hkl")), F.lit(0))
        d = d.withColumn(f"g{a}", (x + F.floor(F.col(f"n{a}") / 2)).cast("int"))
    on = F.lit(True)
    for a in "hkl":
        on = on & F.col(f"g{a}").between(0, F.col(f"n{a}") - 1)
    return d.filter(on).withColumn("op", F.col("_o.op")).drop("_o", "nh", "nk", "nl")


def orbit_average(bins: DataFrame, volumes: DataFrame, ops: tuple[tuple[int, ...], ...]) -> DataFrame:
    """Each on-grid member of an orbit gets the mean over all operations' measured images, so gaps fill from equivalents.

    A bin on a symmetry element is counted once for each operation that fixes it, in sum and count alike.
    σ is √Σσ² over the images, divided by their number.
    """
    i = images(bins.filter(measured()).select(*BINKEY, "intensity", "sigma"), volumes, ops)
    return i.groupBy("volume_id", F.col("gh").alias("ih"), F.col("gk").alias("ik"), F.col("gl").alias("il")).agg(
        F.avg("intensity").alias("mean"), F.count("*").alias("n"), (F.sqrt(F.sum(F.col("sigma") ** 2)) / F.count("*")).alias("sigma")
    )


def r_int(bins: DataFrame, volumes: DataFrame, ops: tuple[tuple[int, ...], ...]) -> DataFrame:
    """Σ|I − ⟨I⟩| / Σ|I| over measured members of orbits that are measured at least twice."""
    m = bins.filter(measured()).select(*BINKEY, "intensity")
    size = hinted(volumes.select("volume_id", F.col("nk").alias("_k"), F.col("nl").alias("_l")))
    i = images(m, volumes, ops).join(size, "volume_id")
    flat = (F.col("gh").cast("long") * F.col("_k") + F.col("gk")) * F.col("_l") + F.col("gl")
    own = i.groupBy(*BINKEY).agg(F.min(flat).alias("orbit"), F.max("intensity").alias("x"))
    g = own.groupBy("volume_id", "orbit").agg(F.avg("x").alias("mean"), F.count("*").alias("c"))
    j = own.join(g.filter("c >= 2"), ["volume_id", "orbit"])
    return j.groupBy("volume_id").agg((F.sum(F.abs(F.col("x") - F.col("mean"))) / F.sum(F.abs("x"))).alias("r_int"), F.count("*").alias("n"))


def mirror_pairs(bins: DataFrame, volumes: DataFrame) -> DataFrame:
    """Measured bins with the value at −Q (both measured)."""
    i = images(bins.filter(measured()).select(*BINKEY, F.col("intensity").alias("y")), volumes, ((-1, 0, 0, 0, -1, 0, 0, 0, -1),))
    i = i.select("volume_id", F.col("gh").alias("ih"), F.col("gk").alias("ik"), F.col("gl").alias("il"), "y")
    return bins.filter(measured()).select(*BINKEY, F.col("intensity").alias("x")).join(i, BINKEY)


def orbit_closure(mask: DataFrame, volumes: DataFrame, ops: tuple[tuple[int, ...], ...]) -> DataFrame:
    """Bins of which any equivalent is in mask."""
    i = images(mask.select(*BINKEY), volumes, ops)
    return i.select("volume_id", F.col("gh").alias("ih"), F.col("gk").alias("ik"), F.col("gl").alias("il")).distinct()


# --- nodes, peaks, punches and fills ----------------------------------------------------------------------


def nodes(bins: DataFrame, cell: tuple[int, int, int] = (1, 1, 1), half: float = 0.3) -> DataFrame:
    """Measured bins of each node's detection window, with the node's integer indices; the origin is no node."""
    b = bins.filter(measured())
    inside = F.lit(True)
    for a, c in zip("hkl", cell, strict=True):
        b = b.withColumn(f"n{a}", (c * F.rint(F.col(a) / c)).cast("int"))
        inside = inside & (F.abs(F.col(a) - F.col(f"n{a}")) <= half)
    return b.filter(inside & ~((F.col("nh") == 0) & (F.col("nk") == 0) & (F.col("nl") == 0)))


def node_peaks(windows: DataFrame) -> DataFrame:
    """Brightest bin, median and count of each node's window (the least index on a tie)."""
    key = ["volume_id", "nh", "nk", "nl"]
    top = F.max(F.struct("intensity", (-F.col("ih")).alias("a"), (-F.col("ik")).alias("b"), (-F.col("il")).alias("c")))
    g = windows.groupBy(*key).agg(top.alias("_t"), F.expr("percentile(intensity, 0.5)").alias("median"), F.count("*").alias("n"))
    return g.select(*key, (-F.col("_t.a")).alias("ih"), (-F.col("_t.b")).alias("ik"), (-F.col("_t.c")).alias("il"), F.col("_t.intensity").alias("peak"), "median", "n")


def punch(bins: DataFrame, peaks: DataFrame, radii: tuple[int, int, int]) -> DataFrame:
    """Bins inside an ellipsoid of integer radii about any peak: peaks explode their box, then an equi-join."""
    a, b, c = radii
    box = [(x, y, z) for x in range(-a, a + 1) for y in range(-b, b + 1) for z in range(-c, c + 1) if (x / max(a, 1)) ** 2 + (y / max(b, 1)) ** 2 + (z / max(c, 1)) ** 2 <= 1]
    o = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.lit(z).alias("c")) for x, y, z in box])
    hit = peaks.select("volume_id", "ih", "ik", "il", F.explode(o).alias("_o")).select(
        "volume_id", (F.col("ih") + F.col("_o.a")).alias("ih"), (F.col("ik") + F.col("_o.b")).alias("ik"), (F.col("il") + F.col("_o.c")).alias("il")
    ).distinct()
    return bins.join(hit.withColumn("_p", F.lit(True)), BINKEY, "left").withColumn("punched", F.coalesce(F.col("_p") & F.col("measured"), F.lit(False))).drop("_p")


def local_fill(bins: DataFrame, holes: DataFrame, radius: int = 2, least: int = 8) -> DataFrame:
    """Median and σ of the measured bins around each hole region; the volume's median where there are too few.

    holes: (volume_id, ih, ik, il, region).  Regions explode their surroundings once, as distinct bins.
    """
    around = offsets(holes.select(*BINKEY, "region"), radius).select("volume_id", "region", F.col("nh").alias("ih"), F.col("nk").alias("ik"), F.col("nl").alias("il")).distinct()
    ok = bins.filter(measured()).join(holes.select(*BINKEY), BINKEY, "left_anti").select(*BINKEY, "intensity")
    whole = ok.groupBy("volume_id").agg(F.expr("percentile(intensity, 0.5)").alias("_m"), F.stddev_pop("intensity").alias("_s"))
    g = around.join(ok, BINKEY).groupBy("volume_id", "region").agg(F.expr("percentile(intensity, 0.5)").alias("m"), F.stddev_pop("intensity").alias("s"), F.count("*").alias("n"))
    r = holes.select("volume_id", "region").distinct().join(g, ["volume_id", "region"], "left").join(hinted(whole), "volume_id")
    few = F.coalesce(F.col("n"), F.lit(0)) < least
    return r.select("volume_id", "region", F.coalesce("n", F.lit(0)).alias("n"), F.when(few, F.col("_m")).otherwise(F.col("m")).alias("fill"), F.when(few, F.col("_s")).otherwise(F.col("s")).alias("sigma"))


def pair_combine(sample: DataFrame, empty: DataFrame, scale: float) -> DataFrame:
    """sample − scale·empty bin by bin; σ in quadrature; measured where both are."""
    e = empty.select(*BINKEY[1:], F.col("intensity").alias("_e"), F.col("sigma").alias("_s"), F.col("measured").alias("_m"))
    j = sample.join(e, BINKEY[1:])
    return j.withColumn("intensity", F.col("intensity") - scale * F.col("_e")).withColumn("sigma", F.sqrt(F.col("sigma") ** 2 + (scale * F.col("_s")) ** 2)).withColumn(
        "measured", F.col("measured") & F.col("_m")
    ).drop("_e", "_s", "_m")


def empty_scale(sample: DataFrame, empty: DataFrame, q_low: float, q_high: float, clip: float = 0.99) -> DataFrame:
    """ΣI_s·I_e / ΣI_e² over a |Q| window, values of the empty scan above its clip percentile left out; 1 under 10 bins."""
    e = empty.filter(measured()).select(*BINKEY[1:], F.col("intensity").alias("e"))
    j = sample.filter(measured() & F.col("q").between(q_low, q_high)).select("volume_id", *BINKEY[1:], "intensity").join(e, BINKEY[1:])
    top = j.groupBy("volume_id").agg(F.expr(f"percentile(e, {clip})").alias("_top"))
    j = j.join(hinted(top), "volume_id").filter("e <= _top")
    g = j.groupBy("volume_id").agg(F.sum(F.col("intensity") * F.col("e")).alias("se"), F.sum(F.col("e") ** 2).alias("ee"), F.count("*").alias("n"))
    return g.select("volume_id", "n", F.when((F.col("n") >= 10) & (F.col("ee") > 0), F.col("se") / F.col("ee")).otherwise(1.0).alias("scale"))


def top_k(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The k largest of each volume, equal values in index order."""
    w = Window.partitionBy("volume_id").orderBy(F.col(by).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
