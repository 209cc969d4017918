"""Predicates and sections over bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import bounded, hinted


def measured() -> Column:
    """What every statistic starts from: measured and finite."""
    return F.col("measured") & ~F.isnan("intensity") & F.col("intensity").isNotNull()


def q_band(bins: DataFrame, low: float, high: float) -> DataFrame:
    """Bins outside [low, high] in |Q| become unmeasured, value and σ zero."""
    inside = F.col("q").between(low, high)
    return bins.withColumn("intensity", F.when(inside, F.col("intensity")).otherwise(0.0)).withColumn(
        "sigma", F.when(inside, F.col("sigma")).otherwise(0.0)
    ).withColumn("measured", F.col("measured") & inside)


def crop(bins: DataFrame, h: float, k: float, l: float) -> DataFrame:
    return bins.filter((F.abs("h") <= h) & (F.abs("k") <= k) & (F.abs("l") <= l))


PLANES = {"0kl": "h", "h0l": "k", "hk0": "l", "h": "h", "k": "k", "l": "l"}


def section(bins: DataFrame, plane: str, value: float = 0.0) -> DataFrame:
    """The plane of each volume nearest to a coordinate (the lower index on a tie)."""
    axis = PLANES[plane.lower()]
    at = bins.groupBy("volume_id").agg(F.min(F.struct(F.abs(F.col(axis) - value), F.col(f"i{axis}"))).alias("_m"))
    at = at.select("volume_id", F.col(f"_m.i{axis}").alias(f"i{axis}"))
    return bins.join(hinted(at), ["volume_id", f"i{axis}"])


def section_between(bins: DataFrame, plane: str, value: float) -> DataFrame:
    """Linear blend of the two planes that bracket a coordinate; where one is unmeasured the other stands alone."""
    axis = PLANES[plane.lower()]
    others = [a for a in "hkl" if a != axis]
    x = F.col(axis)
    ends = bins.groupBy("volume_id").agg(
        F.coalesce(F.max(F.when(x <= value, x)), F.min(x)).alias("_lo"), F.coalesce(F.min(F.when(x >= value, x)), F.max(x)).alias("_hi")
    )
    b = bins.filter(measured()).join(hinted(ends), "volume_id").filter((x == F.col("_lo")) | (x == F.col("_hi")))
    w = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(1 - F.abs(x - F.least(F.greatest(F.lit(value), F.col("_lo")), F.col("_hi"))) / (F.col("_hi") - F.col("_lo")))
    g = b.withColumn("_w", w).groupBy("volume_id", *[f"i{a}" for a in others]).agg(
        F.sum(F.col("_w") * F.col("intensity")).alias("_s"), F.sum("_w").alias("_n"), F.avg("intensity").alias("_mean")
    )
    return g.select("volume_id", *[f"i{a}" for a in others], F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.col("_mean")).alias("value"))


def ring_mask(bins: DataFrame, rings: DataFrame) -> DataFrame:
    """Bins whose |Q| lies in no shell (q_lo, q_hi) of rings."""
    return bins.join(bounded(rings), F.col("q").between(F.col("q_lo"), F.col("q_hi")), "left_anti")


def near_node(cell: tuple[int, int, int], ub: tuple[float, ...], radius: float) -> Column:
    """Within radius (in |Q|) of the nearest node of a parent lattice."""
    from ..functions.geometry import q_magnitude

    d = [F.col(a) - c * F.rint(F.col(a) / c) for a, c in zip("hkl", cell, strict=True)]
    return q_magnitude(ub, *d) <= radius


def in_band(form: tuple[int, int, int], centre: float, half: float, period: float) -> Column:
    """form·(h, k, l) within half of centre, modulo period."""
    x = sum((f * F.col(a) for f, a in zip(form, "hkl", strict=True)), F.lit(0.0))
    return F.abs(F.pmod(x - centre + period / 2, F.lit(float(period))) - period / 2) <= half


def protected(bins: DataFrame, positions: DataFrame) -> DataFrame:
    """bins with ``position_id``: the first declared band (fh, fk, fl, centre, half, period) that covers each, else null."""
    x = F.col("fh") * F.col("h") + F.col("fk") * F.col("k") + F.col("fl") * F.col("l")
    d = F.abs(F.pmod(x - F.col("centre") + F.col("period") / 2, F.col("period")) - F.col("period") / 2)
    hit = bins.select("volume_id", "ih", "ik", "il", "h", "k", "l").join(bounded(positions), d <= F.col("half"))
    hit = hit.groupBy("volume_id", "ih", "ik", "il").agg(F.min("position_id").alias("position_id"))
    return bins.join(hit, ["volume_id", "ih", "ik", "il"], "left")


def nearest_position(points: DataFrame, positions: DataFrame) -> DataFrame:
    """points with the nearest declared position and its distance (the least id on a tie).

    The table of positions is bounded (checked when hinted); each point is compared with every one of them.
    """
    x = F.col("fh") * F.col("h") + F.col("fk") * F.col("k") + F.col("fl") * F.col("l")
    d = F.abs(F.pmod(x - F.col("centre") + F.col("period") / 2, F.col("period")) - F.col("period") / 2)
    keys = points.columns
    g = points.join(bounded(positions)).withColumn("_d", d).groupBy(*keys).agg(F.min(F.struct("_d", "position_id")).alias("_m"))
    return g.select(*keys, F.col("_m.position_id").alias("position_id"), F.col("_m._d").alias("distance"))


def line_profile(bins: DataFrame, start: tuple, end: tuple, n: int, origin: tuple, step: tuple) -> DataFrame:
    """Trilinear profile at n points between two (h, k, l); each point reads its eight corners by an equi-join.

    value is null where any corner of positive weight is missing or unmeasured.
    """
    spark = bins.sparkSession
    p = spark.range(n).select(F.col("id").cast("int").alias("point"), *[
        ((F.lit(s) + (F.lit(e) - F.lit(s)) * F.col("id") / (n - 1) - F.lit(o)) / F.lit(d)).alias(f"_{a}")
        for a, s, e, o, d in zip("hkl", start, end, origin, step, strict=True)
    ])
    c = p
    for a in "hkl":
        c = c.withColumn(f"_c{a}", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(f"i{a}", (F.floor(F.col(f"_{a}") + 1e-9) + F.col(f"_c{a}")).cast("int"))
    w = F.lit(1.0)
    for a in "hkl":
        f = F.greatest(F.col(f"_{a}") - F.floor(F.col(f"_{a}") + 1e-9), F.lit(0.0))
        w = w * F.when(F.col(f"_c{a}") == 1, f).otherwise(1 - f)
    c = c.withColumn("_w", w).filter("_w > 1e-9").select("point", "ih", "ik", "il", "_w")
    vols = hinted(bins.select("volume_id").distinct())
    c = bounded(c).crossJoin(vols)  # n points times 8 corners times volumes
    got = c.join(bins.filter(measured()).select("volume_id", "ih", "ik", "il", "intensity"), ["volume_id", "ih", "ik", "il"], "left")
    g = got.groupBy("volume_id", "point").agg(F.sum(F.col("_w") * F.col("intensity")).alias("_s"), F.sum("_w").alias("_t"), F.sum(F.when(F.col("intensity").isNotNull(), F.col("_w"))).alias("_g"))
    return g.select("volume_id", "point", F.when(F.col("_g") >= F.col("_t") - 1e-6, F.col("_s") / F.col("_t")).alias("value"))


def first_of(bins: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a given order (a stable tie-break belongs in the order)."""
    return bins.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
