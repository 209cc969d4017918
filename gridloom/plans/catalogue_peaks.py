"""Registered queries of peak shapes, measured centres, angular shells, windows, tails and off-lattice peaks.

Inputs of each come from the stages before it: widths feed footprints, centres the rotation, the rotation the tail sweep.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import angular as an
from ..operators import apodize as ap
from ..operators import cells as ce
from ..operators import centres as ct
from ..operators import rings as rg
from ..operators import satellites as sa
from ..operators import shapes as sp
from ..operators import tails as tl
from .catalogue import STEP
from .catalogue_more import _TOP, _peaks
from .registry import lat, query, r6, sh

#: Bins of these volumes are 0.28 Å⁻¹ wide, so the resolution is too.
RESOLUTION = (0.5, 0.5, 0.5)
_REACH = sp.LINE_REACH


def _count_above(side: str) -> str:
    """Bins above the half in a row from the peak, as nested cases."""
    out = str(_REACH)
    for i in range(_REACH, 0, -1):
        out = f"CASE WHEN COALESCE({side}{i} > half, FALSE) THEN {out} ELSE {i - 1} END"
    return out


def _crossing(side: str) -> str:
    v = f"[v0, {', '.join(f'{side}{i}' for i in range(1, _REACH + 1))}]"
    inner, outer = f"{v}[n_{side} + 1]", f"{v}[n_{side} + 2]"
    return f"CASE WHEN n_{side} < {_REACH} AND COALESCE({inner} > {outer}, FALSE) THEN n_{side} + ({inner} - half) / ({inner} - {outer}) ELSE n_{side} + 0.5e0 END"


_CUT = "SELECT p.volume_id, peak_id, '{a}' AS axis, b.i{a} - p.i{a} AS d, intensity FROM pks p JOIN bins b USING (volume_id, {others}) WHERE measured AND ABS(b.i{a} - p.i{a}) <= {r}"
_CUTS = " UNION ALL ".join(_CUT.format(a=a, others=", ".join(f"i{x}" for x in "hkl" if x != a), r=_REACH) for a in "hkl")
_READ = ", ".join(f"MAX(intensity) FILTER (d = {s}{i}) AS {n}{i}" for n, s in (("m", "-"), ("p", "")) for i in range(1, _REACH + 1))
_AXIS = ", ".join(f"ROUND(MAX(w) FILTER (axis = '{a}'), 6) AS fwhm_{a}" for a in "hkl") + ", " + ", ".join(f"MAX(n) FILTER (axis = '{a}') AS bins_{a}" for a in "hkl")


@query("dom_line_widths", f""", ln AS ({_CUTS}),
    rd AS (SELECT volume_id, peak_id, axis, MAX(intensity) FILTER (d = 0) AS v0, {_READ} FROM ln GROUP BY ALL),
    hf AS (SELECT *, (m{_REACH} + p{_REACH}) / 2 + 0.5e0 * (v0 - (m{_REACH} + p{_REACH}) / 2) AS half FROM rd WHERE v0 > (m{_REACH} + p{_REACH}) / 2),
    ct AS (SELECT *, {_count_above("m")} AS n_m, {_count_above("p")} AS n_p FROM hf),
    wd AS (SELECT volume_id, peak_id, axis, 0.2e0 * ({_crossing("m")} + {_crossing("p")}) AS w, CAST(n_m + n_p + 1 AS INT) AS n FROM ct)
    SELECT p.volume_id, CAST(p.peak_id AS INT) AS peak_id, {_AXIS} FROM pks p LEFT JOIN wd USING (volume_id, peak_id) GROUP BY ALL""", _TOP)  # fmt: skip
def _(b, v):
    return r6(sp.line_widths(_peaks(b), b, v), "fwhm_h", "fwhm_k", "fwhm_l")


def _shapes(b, v):
    return sp.fit_shapes(_peaks(b), b, v, RESOLUTION, noise_limit=0.5)


@query("dom_peak_shapes")
def _(b, v):
    s = _shapes(b, v)
    s = s.select("volume_id", "peak_id", "status", "background", "excess", "noise", "n_core", "ch", "ck", "cl", *[F.col("widths")[i].alias(f"width_{i}") for i in range(3)], *[F.col("shape")[i].alias(f"a{i}") for i in range(9)])
    return r6(s, "background", "excess", "noise", "ch", "ck", "cl", *[f"width_{i}" for i in range(3)], *[f"a{i}" for i in range(9)])


def _profile(b, v):
    peaks = _peaks(b).withColumn("significance", F.col("peak"))
    return sp.stacked_profile(sp.stack_samples(peaks, b, v, least_bins=5, least_share=0.2), least_peaks=5)


@query("dom_stacked_profile")
def _(b, v):
    p = _profile(b, v).select("volume_id", "band", "q", "n_peaks", "axis", "sigma", F.posexplode(F.arrays_zip("distances", "profile", "template")).alias("place", "p"))
    return r6(p.select("volume_id", "band", "q", "n_peaks", "axis", "sigma", "place", "p.distances", "p.profile", "p.template"), "q", "sigma", "distances", "profile", "template")


@query("dom_shape_punch")
def _(b, v):
    fits = _shapes(b, v).filter("status = 'fitted'")
    foot = sp.profile_footprints(fits.select("volume_id", "peak_id", "ch", "ck", "cl", "excess", "noise"), _profile(b, v), v, resolution=(0.3, 0.3, 0.3))
    return sp.punch_shapes(b, foot, v).filter("punched").select("volume_id", "ih", "ik", "il", "intensity")


# --- centres and orientation ------------------------------------------------------------------------------

#: Limits at which these coarse volumes show peaks at all.
_SEARCH = {"reach": 0.45, "least": 0.5, "window": 0.8}


@query("dom_measured_centres")
def _(b, v):
    c = ct.measured_centres(b, v, **_SEARCH)
    z = F.when(F.col("significance") < float("inf"), F.col("significance"))  # a shell without scatter
    return r6(c.withColumn("significance", z), "ch", "ck", "cl", "excess", "significance")


@query("dom_refined_orientation")
def _(b, v):
    _, f = ct.refined_orientation(b, v, "both", passes=2, **_SEARCH)
    return r6(f.select("volume_id", "n", "used", "rms", "angle", *[F.col("fitted")[i].alias(f"u{i}") for i in range(9)]), "rms", "angle", *[f"u{i}" for i in range(9)])


# --- shells with an angular field -------------------------------------------------------------------------


def _shells(b):
    """Rings of a volume's profile above its SNIP baseline, with their half-height widths; and the baseline."""
    p = lat.saved(sh.radial_profile(b, STEP, "median").filter("value is not null").select("volume_id", "shell", "value"))
    base = lat.saved(sh.snip(p, 3))
    over = p.join(base.select("volume_id", "shell", "baseline"), ["volume_id", "shell"]).select("volume_id", "shell", (F.col("value") - F.col("baseline")).alias("value"))
    top = rg.profile_peaks(over, share=0.3)
    rings = top.select("volume_id", F.col("top").cast("int").alias("ring_id"), ((F.col("top") + 0.5) * STEP).alias("q0"), (F.coalesce("width", F.lit(1)) * STEP).alias("fwhm"), "height")
    return rings, base.select("volume_id", "shell", F.col("baseline").alias("value"))


@query("dom_global_shells")
def _(b, v):
    rings, base = _shells(b)
    f = an.fit_shells(b, v, rings, base, STEP, degree=2, least=3)
    return r6(f.select("volume_id", "ring_id", "degree", "n_cells", "coverage", "scale", "ceiling", "residual_rms", F.col("beta")[0].alias("b0")), "coverage", "scale", "ceiling", "residual_rms", "b0")


@query("dom_global_shells_removed")
def _(b, v):
    rings, base = _shells(b)
    rings = lat.saved(rings)
    fits = lat.saved(an.fit_shells(b, v, rings, base, STEP, degree=2, least=3))
    out = an.remove_shells(b, an.shell_model(b, v, rings, fits, base, STEP)).filter("measured")
    return r6(out.select("volume_id", "ih", "ik", "il", "intensity", "sigma", "removed"), "intensity", "sigma", "removed")


# --- the window of the transform --------------------------------------------------------------------------


@query("dom_window_ellipsoid")
def _(b, v):
    w = ap.fitted_windows(b, v, tolerance=0.05)
    return r6(w.select("volume_id", "n_ops", "scale", "open_weight", *[F.col("form")[i].alias(f"m{i}") for i in (0, 1, 2, 4, 5, 8)]), "open_weight", *[f"m{i}" for i in (0, 1, 2, 4, 5, 8)])


# --- tails and peaks off the lattice ----------------------------------------------------------------------


@query("dom_tail_sweep")
def _(b, v):
    c = lat.saved(ct.measured_centres(b, v, **_SEARCH).filter("status = 'centred'"))
    u = (1.4, 1.4, 1.2)
    off = c.select("volume_id", *[(s * F.col(f"n{a}")).alias(f"q{x}") for s, a, x in zip(u, "hkl", "xyz", strict=True)], *[(s * (F.col(f"c{a}") - F.col(f"n{a}"))).alias(f"d{x}") for s, a, x in zip(u, "hkl", "xyz", strict=True)], F.lit(1.0).alias("w"))
    turn = lat.saved(ce.rotation_fit(off).filter("wx is not null").select("volume_id", "wx", "wy", "wz"))
    fits = _shapes(b, v).filter("shape is not null")
    node = _peaks(b).select("volume_id", "peak_id", "ih", "ik", "il", "nh", "nk", "nl")
    holes = lat.saved(fits.select("volume_id", "peak_id", "ch", "ck", "cl", "shape").join(node, ["volume_id", "peak_id"]))
    nodes, _ = tl.sweep_tails(sp.punch_shapes(b, holes, v), v, holes, turn, gate=2.0, grow=1.0)
    return r6(nodes, "q", "shift", "excess_before", "excess_removed")


_AWAY = """, th AS (SELECT volume_id, quantile_cont(intensity, 0.98) AS t FROM bins WHERE measured GROUP BY 1),
    el AS (SELECT b.volume_id, h, k, l, intensity >= t AS peak FROM bins b JOIN th USING (volume_id) WHERE measured AND NOT (ABS(h - ROUND(h / 2) * 2) <= 0.2e0 + 1e-9 AND ABS(k - ROUND(k / 2) * 2) <= 0.2e0 + 1e-9 AND ABS(l - ROUND(l / 2) * 2) <= 0.2e0 + 1e-9)),
    xs AS (SELECT volume_id, peak, 'h' AS coordinate, h AS x, k AS y, l AS z FROM el UNION ALL SELECT volume_id, peak, 'k', k, h, l FROM el UNION ALL SELECT volume_id, peak, 'l', l, h, k FROM el),
    fr AS (SELECT xs.*, q, ROUND(x * q / 2) AS f, ABS(x - ROUND(x * q / 2) * 2 / q) AS away FROM xs, (VALUES (2), (3), (4)) t(q)),
    ht AS (SELECT *, away <= 0.2e0 + 1e-9 AND gcd(CAST(f AS BIGINT), q) = 1 AS hit FROM fr),
    cn AS (SELECT volume_id, coordinate, q AS denominator, COUNT(*) FILTER (peak) AS n, COUNT(*) FILTER (peak AND hit) AS hits, AVG(away) FILTER (peak AND hit) AS distance,
      COUNT(*) FILTER (peak AND hit AND ABS(y - ROUND(y / 2) * 2) <= 0.2e0 + 1e-9 AND ABS(z - ROUND(z / 2) * 2) <= 0.2e0 + 1e-9) AS aside, COUNT(*) FILTER (hit) / COUNT(*) AS p0 FROM ht GROUP BY ALL HAVING COUNT(*) FILTER (peak) > 0),
    pv AS (SELECT *, CASE WHEN hits = 0 THEN 1 ELSE LEAST(1, list_sum(list_transform(range(hits, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p0) + (n - i) * ln(1 - p0))))) END AS p FROM cn)
    SELECT volume_id, coordinate, CAST(denominator AS INT) AS denominator, n, hits, ROUND(distance, 6) AS distance, aside, ROUND(p0, 6) AS p0, ROUND(p, 6) AS p_value, hits >= 3 AND p <= 1.35e-3 / 9 AS fired FROM pv"""


def _bright(b):
    """The brightest fiftieth of a volume's measured bins."""
    t = b.filter("measured").groupBy("volume_id").agg(F.expr("percentile(intensity, 0.98)").alias("_t"))
    return b.filter("measured").join(t, "volume_id").filter("intensity >= _t")


@query("dom_bunching", _AWAY)
def _(b, v):
    c = sa.bunching_counts(_bright(b), v, b.filter("measured"), cell=(2, 2, 2))
    return r6(sa.bunching(c).select("volume_id", "coordinate", "denominator", "n", "hits", "distance", "aside", "p0", "p_value", "fired"), "distance", "p0", "p_value")


@query("dom_grain_check")
def _(b, v):
    off = _bright(b).filter("greatest(abs(h - rint(h)), abs(k - rint(k)), abs(l - rint(l))) > 0.25").select("volume_id", "h", "k", "l", "intensity")
    g = sa.grain_check(off, v)
    return r6(g, "offset_low", "offset_median", "offset_high", "misorientation")
