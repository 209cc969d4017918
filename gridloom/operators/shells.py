"""Radial shells, exact floors, robust statistics, coverage, and the pedestal they carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.form_factor import form_factor
from ..functions.geometry import inverse
from ..functions.sizes import hinted
from .filters import measured

#: Scale of the median absolute deviation of a normal distribution.
MAD_SCALE = 1.4826
BINKEY = ["volume_id", "ih", "ik", "il"]


def shell(q: Column, q0: float, step: float, n: int | None = None) -> Column:
    """Index b of the half-open shell q0 + b·step <= q < q0 + (b + 1)·step; ends are clipped if n is given.

    The quotient is corrected against the edges themselves, so a value on an edge lands as the edges say.
    """
    b = F.floor((q - q0) / step)
    b = F.when(q < q0 + b * step, b - 1).when(q >= q0 + (b + 1) * step, b + 1).otherwise(b)
    if n is not None:
        b = F.least(F.greatest(b, F.lit(0)), F.lit(n - 1))
    return b.cast("int")


def measured_q_range(bins: DataFrame) -> DataFrame:
    return bins.filter(measured()).groupBy("volume_id").agg(F.min("q").alias("q_min"), F.max("q").alias("q_max"))


def radial_profile(bins: DataFrame, step: float, stat: str = "mean", least: int = 3) -> DataFrame:
    """Mean or median and count of each shell; null under ``least`` bins."""
    value = F.avg("intensity") if stat == "mean" else F.expr("percentile(intensity, 0.5)")
    g = bins.filter(measured()).withColumn("shell", shell(F.col("q"), 0.0, step)).groupBy("volume_id", "shell").agg(value.alias("value"), F.count("*").alias("n"))
    return g.withColumn("value", F.when(F.col("n") >= least, F.col("value")))


def shell_stats(bins: DataFrame, step: float, least: int = 8) -> DataFrame:
    """Median and robust scale of each shell: 1.4826·MAD, the standard deviation where that is 0, 1 where both are."""
    b = bins.filter(measured()).withColumn("shell", shell(F.col("q"), 0.0, step)).select("volume_id", "shell", "intensity")
    m = b.groupBy("volume_id", "shell").agg(F.expr("percentile(intensity, 0.5)").alias("median"), F.count("*").alias("n"), F.stddev_pop("intensity").alias("sd"))
    d = b.join(m, ["volume_id", "shell"]).groupBy("volume_id", "shell").agg(F.expr("percentile(abs(intensity - median), 0.5)").alias("mad"))
    scale = F.when(F.col("mad") > 0, MAD_SCALE * F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    enough = F.col("n") >= least
    return m.join(d, ["volume_id", "shell"]).select("volume_id", "shell", "n", F.when(enough, F.col("median")).alias("median"), F.when(enough, scale).alias("scale"))


def shell_thresholds(stats: DataFrame, n_scale: float, floor: float) -> DataFrame:
    return stats.withColumn("threshold", F.greatest(F.lit(floor), F.col("median") + n_scale * F.col("scale")))


def diffuse_scatter(stats: DataFrame) -> DataFrame:
    """Count-weighted median of the shells' scales."""
    s = stats.filter("scale is not null")
    w = Window.partitionBy("volume_id")
    s = s.withColumn("_c", F.sum("n").over(w.orderBy("scale", "shell"))).withColumn("_t", F.sum("n").over(w))
    return s.filter("2 * _c >= _t").groupBy("volume_id").agg(F.min("scale").alias("scatter"))


def shell_floors(bins: DataFrame, step: float, percentile: float = 25.0, least: int = 20) -> DataFrame:
    """Exact percentile and median of each shell (linear interpolation), with measured and total counts."""
    b = bins.withColumn("shell", shell(F.col("q"), 0.0, step)).withColumn("_x", F.when(measured(), F.col("intensity")))
    g = b.groupBy("volume_id", "shell").agg(
        F.count("_x").alias("n_measured"), F.count("*").alias("n"), F.expr(f"percentile(_x, {percentile / 100})").alias("floor"),
        F.expr("percentile(_x, 0.5)").alias("median"), F.avg(F.when(F.col("_x").isNotNull(), F.col("q"))).alias("q"),
    )
    return g.withColumn("floor", F.when(F.col("n_measured") >= least, F.col("floor")))


def ranked_floors(bins: DataFrame, step: float, percentile: float = 25.0, cuts: int = 64) -> DataFrame:
    """The percentile of :func:`shell_floors` for shells too large for one group, by value counts and ranks.

    Equal values are counted first (combined before the shuffle), then the two order statistics around the
    rank are picked from running counts over value brackets, so no task holds a shell's bins.
    """
    b = bins.filter(measured()).withColumn("shell", shell(F.col("q"), 0.0, step))
    c = b.groupBy("volume_id", "shell", "intensity").agg(F.count("*").alias("c"))
    ends = b.groupBy("volume_id", "shell").agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"), F.count("*").alias("_n"))
    c = c.join(ends, ["volume_id", "shell"])
    c = c.withColumn("_cut", F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("intensity") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cuts)).otherwise(0))
    sizes = c.groupBy("volume_id", "shell", "_cut").agg(F.sum("c").alias("_s"))
    own = Window.partitionBy("volume_id", "shell").orderBy("_cut")
    sizes = sizes.withColumn("_before", F.sum("_s").over(own) - F.col("_s")).drop("_s")
    c = c.join(sizes, ["volume_id", "shell", "_cut"])
    inside = Window.partitionBy("volume_id", "shell", "_cut").orderBy("intensity")
    c = c.withColumn("_upto", F.col("_before") + F.sum("c").over(inside))
    rank = (F.col("_n") - 1) * (percentile / 100)
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("intensity")))
    g = c.groupBy("volume_id", "shell").agg(F.max("_n").alias("n_measured"), at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_b"))
    r = (F.col("n_measured") - 1) * (percentile / 100)
    return g.select("volume_id", "shell", "n_measured", (F.col("_a") + (F.col("_b") - F.col("_a")) * (r - F.floor(r))).alias("floor"))


def trimmed_profile(bins: DataFrame, step: float, low: float = 10.0, high: float = 90.0, least: int = 5) -> DataFrame:
    """Mean of each shell between two of its own percentiles."""
    b = bins.filter(measured()).withColumn("shell", shell(F.col("q"), 0.0, step)).select("volume_id", "shell", "intensity")
    p = b.groupBy("volume_id", "shell").agg(F.expr(f"percentile(intensity, array({low / 100}, {high / 100}))").alias("_p"), F.count("*").alias("n"))
    inside = F.col("intensity").between(F.col("_p")[0], F.col("_p")[1])
    g = b.join(p, ["volume_id", "shell"]).groupBy("volume_id", "shell").agg(F.avg(F.when(inside, F.col("intensity"))).alias("value"), F.max("n").alias("n"))
    return g.withColumn("value", F.when(F.col("n") >= least, F.col("value")))


def sector_profiles(bins: DataFrame, plane: str, step: float, sectors: int = 8) -> DataFrame:
    """Median and count per plane, azimuthal sector and shell; plane is the axis along the stack."""
    x, y = [F.col(a) for a in "hkl" if a != plane]
    turn = F.pmod(F.floor((F.atan2(y, x) + 3.141592653589793) / (2 * 3.141592653589793) * sectors), F.lit(sectors))
    b = bins.filter(measured()).withColumn("sector", turn.cast("int")).withColumn("shell", shell(F.col("q"), 0.0, step))
    return b.groupBy("volume_id", f"i{plane}", "sector", "shell").agg(F.expr("percentile(intensity, 0.5)").alias("median"), F.count("*").alias("n"))


def across_stack(bins: DataFrame, plane: str, step: float, least: int = 8) -> DataFrame:
    """Median over planes of each plane's own median profile, of planes with at least ``least`` bins in the shell."""
    b = bins.filter(measured()).withColumn("shell", shell(F.col("q"), 0.0, step))
    p = b.groupBy("volume_id", f"i{plane}", "shell").agg(F.expr("percentile(intensity, 0.5)").alias("m"), F.count("*").alias("n"))
    return p.filter(F.col("n") >= least).groupBy("volume_id", "shell").agg(F.expr("percentile(m, 0.5)").alias("median"), F.count("*").alias("n_planes"))


def coverage(bins: DataFrame, volumes: DataFrame, step: float, least: int = 50) -> DataFrame:
    """Total, measured and non-zero bins of each shell of the whole grid (absent rows count), and their shares."""
    from ..functions.geometry import q_magnitude

    g = volumes.select("volume_id", "ub", *[f"{a}0" for a in "hkl"], *[f"d{a}" for a in "hkl"], F.explode(F.expr("sequence(0, nh - 1)")).alias("ih"), "nk", "nl")
    g = g.withColumn("ik", F.explode(F.expr("sequence(0, nk - 1)"))).withColumn("il", F.explode(F.expr("sequence(0, nl - 1)")))
    at = lambda a: F.round(F.col(f"{a}0") + F.col(f"i{a}") * F.col(f"d{a}"), 9)
    g = g.select(*BINKEY, F.floor(q_magnitude(F.col("ub"), at("h"), at("k"), at("l")) / step).cast("int").alias("shell"))
    m = bins.select(*BINKEY, measured().alias("_m"), (measured() & (F.col("intensity") != 0)).alias("_c"))
    r = g.join(m, BINKEY, "left").groupBy("volume_id", "shell").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("_m"), 1)).alias("n_measured"), F.count(F.when(F.col("_c"), 1)).alias("n_counted")
    )
    return r.filter(F.col("n") >= least).withColumn("share", F.col("n_measured") / F.col("n"))


def slice_summary(values: DataFrame, keys: list[str]) -> DataFrame:
    """Median, MAD σ, p01, p99, min, max and negative share of column ``value``."""
    m = values.groupBy(*keys).agg(
        F.expr("percentile(value, array(0.5, 0.01, 0.99))").alias("_p"), F.min("value").alias("least"), F.max("value").alias("largest"),
        F.avg(F.when(F.col("value") < 0, 1.0).otherwise(0.0)).alias("negative"), F.count("value").alias("n"),
    )
    d = values.join(hinted(m.select(*keys, F.col("_p")[0].alias("_m"))), keys).groupBy(*keys).agg((MAD_SCALE * F.expr("percentile(abs(value - _m), 0.5)")).alias("spread"))
    return m.join(d, keys).select(*keys, "n", F.col("_p")[0].alias("median"), "spread", F.col("_p")[1].alias("p01"), F.col("_p")[2].alias("p99"), "least", "largest", "negative")


def undersampled(bins: DataFrame, plane: str, step: float, cells: int = 12, share: float = 0.25) -> DataFrame:
    """bins with ``sampled`` false where their (shell, azimuth) cell holds under a share of the shell's median populated cell."""
    x, y = [F.col(a) for a in "hkl" if a != plane]
    turn = F.pmod(F.floor((F.atan2(y, x) + 3.141592653589793) / (2 * 3.141592653589793) * cells), F.lit(cells)).cast("int")
    key = ["volume_id", f"i{plane}", "shell", "cell"]
    b = bins.withColumn("shell", shell(F.col("q"), 0.0, step)).withColumn("cell", turn)
    c = b.filter(measured()).groupBy(*key).agg(F.count("*").alias("_n"))
    m = c.groupBy(*key[:3]).agg(F.expr("percentile(_n, 0.5)").alias("_m"))
    c = c.join(m, key[:3]).select(*key, (F.col("_n") >= share * F.col("_m")).alias("sampled"))
    return b.join(c, key, "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))


def fit_pedestal(floors: DataFrame, q_low: float, q_high: float, q2: bool = True) -> DataFrame:
    """Least squares of the floors on 1 (and Q²) per volume, weighted by the measured counts: const, slope, r2.

    The sums of the normal equations come from one combined group-by; two unknowns are solved in closed form.
    """
    f = floors.filter(F.col("floor").isNotNull() & F.col("q").between(q_low, q_high)).withColumn("_w", F.col("n_measured").cast("double"))
    x = F.col("q") * F.col("q") if q2 else F.lit(0.0)
    s = lambda e: F.sum(F.col("_w") * e)
    y = F.col("floor")
    g = f.groupBy("volume_id").agg(F.sum("_w").alias("w"), s(x).alias("x"), s(x * x).alias("xx"), s(y).alias("y"), s(x * y).alias("xy"), s(y * y).alias("yy"))
    det = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(det > 0, (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / det).otherwise(0.0)
    g = g.withColumn("slope", slope).withColumn("const", (F.col("y") - F.col("slope") * F.col("x")) / F.col("w"))
    rest = F.col("yy") - F.col("const") * F.col("y") - F.col("slope") * F.col("xy")
    total = F.col("yy") - F.col("y") * F.col("y") / F.col("w")
    return g.select("volume_id", "const", "slope", F.when(total > 0, 1 - rest / total).alias("r2"))


def fit_terms(floors: DataFrame, q_low: float, q_high: float, ion: Sequence[float] | None = None, q2: bool = True) -> DataFrame:
    """Least squares of the floors on 1, F² of an ion and Q² per volume: const, c, b, r2 (null where there is nothing to explain).

    Shells of the range are used, or all of them where fewer than two lie in it; a volume with fewer shells than terms
    gets their mean.  Normal sums of one group-by, solved in columns.
    """
    inside = F.col("q").between(q_low, q_high)
    f = floors.filter("floor is not null").withColumn("_in", F.count_if(inside).over(Window.partitionBy("volume_id"))).filter(inside | (F.col("_in") < 2))
    one, q = F.lit(1.0), F.col("q")
    f = f.select("volume_id", F.col("floor").alias("_y"), one.alias("_x0"), (form_factor(q, ion) ** 2 if ion else F.lit(0.0)).alias("_x1"), (q * q if q2 else F.lit(0.0)).alias("_x2"))
    s = lambda a, b: F.sum(F.col(f"_{a}") * F.col(f"_{b}"))
    g = f.groupBy("volume_id").agg(
        *[s(f"x{i}", f"x{j}").alias(f"m{i}{j}") for i in range(3) for j in range(3)], *[s(f"x{i}", "y").alias(f"b{i}") for i in range(3)],
        s("y", "y").alias("yy"), F.count("*").alias("n"),
    )
    used = [True, ion is not None, q2]  # a term that is not fitted gets the equation x = 0
    m = [F.col(f"m{i}{j}") if used[i] and used[j] else F.lit(float(i == j)) for i in range(3) for j in range(3)]
    inv, y = inverse(m), [F.col(f"b{i}") for i in range(3)]
    enough = F.col("n") >= sum(used)
    x = [F.when(enough, inv[3 * i] * y[0] + inv[3 * i + 1] * y[1] + inv[3 * i + 2] * y[2]) if used[i] else F.lit(0.0) for i in range(3)]
    g = g.withColumn("const", F.coalesce(x[0], F.col("b0") / F.col("n"))).withColumn("c", F.coalesce(x[1], F.lit(0.0))).withColumn("b", F.coalesce(x[2], F.lit(0.0)))
    total = F.col("yy") - F.col("b0") * F.col("b0") / F.col("n")
    rest = F.col("yy") - F.col("const") * F.col("b0") - F.col("c") * F.col("b1") - F.col("b") * F.col("b2")
    return g.select("volume_id", "const", "c", "b", F.when(enough & (total > 0), 1 - rest / total).alias("r2"))


def flatten_terms(bins: DataFrame, terms: DataFrame, q_high: float, ion: Sequence[float] | None = None) -> DataFrame:
    """bins with const + c·F² + b·Q² taken off measured ones (Q² held at the end of the fit range); no fit, no change."""
    b = bins.join(terms.select("volume_id", "const", "c", "b"), "volume_id", "left")
    q = F.least(F.col("q"), F.lit(q_high))
    shape = form_factor(F.col("q"), ion) ** 2 if ion else F.lit(0.0)
    b = b.withColumn("pedestal", F.coalesce(F.col("const") + F.col("c") * shape + F.col("b") * q * q, F.lit(0.0)))
    return b.withColumn("intensity", F.when(F.col("measured"), F.col("intensity") - F.col("pedestal")).otherwise(F.col("intensity"))).drop("const", "c", "b")


def flatten(bins: DataFrame, coefficients: DataFrame, q_high: float) -> DataFrame:
    """bins with the pedestal const + slope·Q² taken off (Q held at the end of the fit range)."""
    q = F.least(F.col("q"), F.lit(q_high))
    b = bins.join(hinted(coefficients.select("volume_id", "const", "slope")), "volume_id")
    b = b.withColumn("pedestal", F.col("const") + F.col("slope") * q * q)
    return b.withColumn("intensity", F.when(F.col("measured"), F.col("intensity") - F.col("pedestal")).otherwise(F.col("intensity"))).drop("const", "slope")


def consistency(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pearson r, RMS and normalised RMS of two values on the same bins, over measured bins of both."""
    keys = keys or ["volume_id"]
    x = a.filter(measured()).select(*BINKEY, F.col("intensity").alias("x"))
    y = b.filter(measured()).select(*BINKEY, F.col("intensity").alias("y"))
    j = x.join(y, BINKEY)
    return j.groupBy(*keys).agg(
        F.corr("x", "y").alias("r"), F.sqrt(F.avg((F.col("x") - F.col("y")) ** 2)).alias("rms"),
        (F.sqrt(F.avg((F.col("x") - F.col("y")) ** 2)) / F.sqrt(F.avg(F.col("x") ** 2))).alias("nrms"), F.count("*").alias("n"),
    )


def rolling_median(profile: DataFrame, half: int) -> DataFrame:
    """profile (volume_id, shell, value) with the running median over shells shell − half to shell + half; ends repeat."""
    ends = profile.groupBy("volume_id").agg(F.min("shell").alias("_lo"), F.max("shell").alias("_hi"))
    near = profile.select("volume_id", "shell", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_d")).join(hinted(ends), "volume_id")
    near = near.withColumn("_s", F.least(F.greatest(F.col("shell") + F.col("_d"), F.col("_lo")), F.col("_hi")))
    v = profile.select("volume_id", F.col("shell").alias("_s"), F.col("value").alias("_v"))
    g = near.join(v, ["volume_id", "_s"], "left").groupBy("volume_id", "shell").agg(F.expr("percentile(_v, 0.5)").alias("baseline"))
    return profile.join(g, ["volume_id", "shell"])


def runs(profile: DataFrame, flag: str, gap: int = 1) -> DataFrame:
    """Runs of flagged shells, merged over gaps of up to ``gap`` shells: (volume_id, run, first, last, peak)."""
    w = Window.partitionBy("volume_id").orderBy("shell")
    r = profile.filter(flag).withColumn("_new", (F.col("shell") - F.lag("shell").over(w) > gap + 1).cast("int"))
    r = r.withColumn("run", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    return r.groupBy("volume_id", "run").agg(F.min("shell").alias("first"), F.max("shell").alias("last"), F.max("value").alias("peak"))


def filled(profile: DataFrame) -> DataFrame:
    """Missing values of a profile by linear interpolation; the ends repeat the nearest value."""
    back, ahead = Window.partitionBy("volume_id").orderBy("shell"), Window.partitionBy("volume_id").orderBy(F.col("shell").desc())
    at = F.when(F.col("value").isNotNull(), F.col("shell"))
    p = profile.withColumn("_v0", F.last("value", True).over(back)).withColumn("_s0", F.last(at, True).over(back))
    p = p.withColumn("_v1", F.last("value", True).over(ahead)).withColumn("_s1", F.last(at, True).over(ahead))
    blend = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("shell") - F.col("_s0")) / (F.col("_s1") - F.col("_s0"))
    return p.withColumn("filled", F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(blend)).drop("_v0", "_s0", "_v1", "_s1")


def smoothed(profile: DataFrame, sigma: float, reach: int) -> DataFrame:
    """Gaussian smoothing of a profile along shells, over the shells that are there."""
    near = profile.filter("value is not null").select("volume_id", F.col("shell").alias("_s"), "value")
    near = near.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("shell", F.col("_s") + F.col("_d"))
    w = F.exp(-0.5 * F.pow(F.col("_d") / sigma, F.lit(2.0)))
    g = near.groupBy("volume_id", "shell").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("smooth"))
    return profile.join(g, ["volume_id", "shell"], "left")


def snip(profile: DataFrame, passes: int) -> DataFrame:
    """SNIP baseline: in pass m each inner bin takes min(x, mean of the bins m away), all from the state before the pass.

    One profile is a small array, so each is one row of higher-order functions.
    """
    a = profile.groupBy("volume_id").agg(F.array_sort(F.collect_list(F.struct("shell", "value"))).alias("_a"))
    a = a.withColumn("_x", F.expr("transform(_a, p -> p.value)"))
    step = (
        f"aggregate(sequence(1, {passes}), _x, (x, m) -> transform(x, (v, i) ->"
        " case when i >= m and i < size(x) - m then least(v, (x[i - m] + x[i + m]) / 2) else v end))"
    )
    a = a.withColumn("_b", F.expr(step)).select("volume_id", F.posexplode(F.arrays_zip("_a", "_b")).alias("_i", "_z"))
    return a.select("volume_id", F.col("_z._a.shell").alias("shell"), F.col("_z._a.value").alias("value"), F.least(F.col("_z._b"), F.col("_z._a.value")).alias("baseline"))
