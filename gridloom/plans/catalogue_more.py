"""More registered queries: peaks, rings, resampling, structure and lineage."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import peaks as pk
from ..operators import resample as rs
from ..operators import rings as rg
from . import lineage as ln
from .catalogue import _PROF, _WINDOW, KEY, STEP
from .registry import flt, lat, query, r6, sh, src, tr

_TOP = _WINDOW + """, pks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ih, ik, il) AS peak_id FROM (
    SELECT volume_id, ih, ik, il FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, nh, nk, nl ORDER BY intensity DESC, ih, ik, il) AS r FROM nod) WHERE r = 1)),
 pwin AS (SELECT p.volume_id, peak_id, b.ih - p.ih AS dh, b.ik - p.ik AS dk, b.il - p.il AS dl, (b.ih - p.ih)**2 + (b.ik - p.ik)**2 + (b.il - p.il)**2 AS d2, intensity, sigma
    FROM pks p JOIN bins b ON b.volume_id = p.volume_id AND ABS(b.ih - p.ih) <= 4 AND ABS(b.ik - p.ik) <= 4 AND ABS(b.il - p.il) <= 4 WHERE measured)"""


def _peaks(b):
    return pk.numbered(lat.node_peaks(lat.nodes(b)))


@query("dom_node_significance", """, bg AS (SELECT volume_id, peak_id, quantile_cont(intensity, 0.5) AS bg, COUNT(*) AS n FROM pwin WHERE d2 > 1 AND d2 <= 4 GROUP BY ALL),
    z AS (SELECT volume_id, peak_id, SUM(intensity - bg) / SQRT(SUM(sigma**2)) AS z, MAX(n) AS n FROM pwin JOIN bg USING (volume_id, peak_id) WHERE d2 <= 1 GROUP BY ALL)
    SELECT volume_id, CAST(peak_id AS INT) AS peak_id, CASE WHEN n >= 8 THEN ROUND(z, 6) END AS z FROM z""", _TOP)
def _(b, v):
    return r6(pk.significance(_peaks(b), b).filter("n > 0").select("volume_id", "peak_id", "z"), "z")


@query("dom_broad_share", """ SELECT volume_id, CAST(peak_id AS INT) AS peak_id, ROUND(AVG(intensity) FILTER (d2 <= 1), 6) AS core, quantile_cont(intensity, 0.5) FILTER (d2 > 1 AND d2 <= 4) AS near, quantile_cont(intensity, 0.5) FILTER (d2 > 9 AND d2 <= 16) AS far FROM pwin GROUP BY ALL""", _TOP)
def _(b, v):
    return r6(pk.broad_share(_peaks(b), b).select("volume_id", "peak_id", "core", "near", "far"), "core")


@query("agg_peak_moments", """, w AS (SELECT *, intensity - MIN(intensity) OVER (PARTITION BY volume_id, peak_id) AS w FROM pwin WHERE ABS(dh) <= 1 AND ABS(dk) <= 1 AND ABS(dl) <= 1)
    SELECT volume_id, CAST(peak_id AS INT) AS peak_id, SUM(w) AS total, ROUND(SUM(w*dh)/SUM(w), 6) AS ch, ROUND(SUM(w*dk)/SUM(w), 6) AS ck, ROUND(SUM(w*dl)/SUM(w), 6) AS cl,
      ROUND(SUM(w*dh*dh)/SUM(w) - (SUM(w*dh)/SUM(w))**2, 6) AS vhh, ROUND(SUM(w*dh*dk)/SUM(w) - SUM(w*dh)/SUM(w)*SUM(w*dk)/SUM(w), 6) AS vhk FROM w GROUP BY ALL HAVING SUM(w) > 0""", _TOP)
def _(b, v):
    return r6(pk.moments(_peaks(b), b).select("volume_id", "peak_id", "total", "ch", "ck", "cl", "vhh", "vhk"), "ch", "ck", "cl", "vhh", "vhk")


@query("agg_peak_widths", """, w AS (SELECT *, intensity - MIN(intensity) OVER (PARTITION BY volume_id, peak_id) AS w FROM pwin WHERE ABS(dh) <= 1 AND ABS(dk) <= 1 AND ABS(dl) <= 1),
    m AS (SELECT volume_id, peak_id, SQRT(GREATEST(SUM(w*dh*dh)/SUM(w) - (SUM(w*dh)/SUM(w))**2, 0)) AS s FROM w GROUP BY ALL HAVING SUM(w) > 0)
    SELECT volume_id, COUNT(*) AS n, ROUND(quantile_cont(s, 0.5), 6) AS median_width FROM m GROUP BY 1""", _TOP)
def _(b, v):
    m = pk.moments(_peaks(b), b).withColumn("s", F.sqrt(F.greatest("vhh", F.lit(0.0))))
    return r6(m.groupBy("volume_id").agg(F.count("*").alias("n"), F.expr("percentile(s, 0.5)").alias("median_width")), "median_width")


@query("jon_claimed_peaks", """ SELECT volume_id, ih, ik, il, nh, nk, nl FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, nh, nk, nl ORDER BY intensity DESC, ih, ik, il) AS r FROM win
    WHERE ABS(h - nh) <= 0.3 AND ABS(k - nk) <= 0.3 AND ABS(l - nl) <= 0.3) WHERE r = 1""", _WINDOW)
def _(b, v):
    return pk.claimed(b.filter("measured").withColumn("value", F.col("intensity"))).select(*KEY, "nh", "nk", "nl")


@query("win_parabola")
def _(b, v):
    return r6(pk.parabola(lat.local_extrema(b), b), "oh", "ok", "ol")


@query("dom_fill_bias", """, h AS (SELECT volume_id, (intensity - 150) / sigma AS s, intensity / 150 - 1 AS l FROM bins WHERE measured AND il = 5),
    g AS (SELECT volume_id, COUNT(*) AS n, quantile_cont(s, 0.5) AS ms, quantile_cont(l, 0.5) AS ml, GREATEST(AVG(CAST(s > 0 AS INT)), AVG(CAST(s < 0 AS INT))) AS way FROM h GROUP BY 1)
    SELECT volume_id, n, ROUND(ms, 6) AS ms, ROUND(ml, 6) AS ml, ROUND(way, 6) AS way, CASE WHEN n >= 5 THEN ABS(ms) >= 0.5 AND ABS(ml) >= 0.2 AND way >= 0.75 END AS systematic FROM g""")
def _(b, v):
    h = b.filter("measured and il = 5").select("volume_id", ((F.col("intensity") - 150) / F.col("sigma")).alias("bias_sigma"), (F.col("intensity") / 150 - 1).alias("bias_level"))
    return r6(pk.fill_bias(h), "ms", "ml", "way")


# --- rings and lines --------------------------------------------------------------------------------------

_AL = """ al AS (SELECT CAST(h*h + k*k + l*l AS INT) AS n, COUNT(*) AS multiplicity, 2 * 3.141592653589793 / 4.0494e0 * SQRT(h*h + k*k + l*l) AS q FROM range(-5, 6) a(h), range(-5, 6) b(k), range(-5, 6) c(l)
   WHERE (h*h + k*k + l*l) > 0 AND (ABS(h) % 2 = ABS(k) % 2) AND (ABS(k) % 2 = ABS(l) % 2) AND 2 * 3.141592653589793 / 4.0494e0 * SQRT(h*h + k*k + l*l) <= 6.0 GROUP BY ALL)"""


@query("jon_ring_lines", """, r AS (SELECT volume_id, shell, (shell + 0.5e0) * 0.25e0 AS q FROM pr WHERE value IS NOT NULL), l AS (SELECT n, MIN(q) AS lq FROM al GROUP BY 1)
    SELECT volume_id, q, (SELECT n FROM l WHERE ABS(lq - r.q) <= 0.12 ORDER BY ABS(lq - r.q), n LIMIT 1) AS line FROM r""", _PROF + "," + _AL)
def _(b, v):
    r = sh.radial_profile(b, STEP, "median").filter("value is not null").select("volume_id", ((F.col("shell") + 0.5) * 0.25).alias("q"))
    return rg.matched(r, rg.cubic_lines(b.sparkSession, 4.0494, 6.0), 0.12).select("volume_id", "q", "line")


def _windows(b):
    return b.sparkSession.createDataFrame([(1, 1.4, 1.7, "core"), (1, 1.1, 1.3, "flank"), (1, 1.8, 2.0, "flank"), (2, 2.1, 2.3, "core"), (2, 1.8, 2.0, "flank"), (2, 2.4, 2.6, "flank")], "window_id int, lo double, hi double, role string")


@query("agg_direction_cells", """, c AS (SELECT volume_id, q, intensity, LEAST(FLOOR((GREATEST(LEAST(1.2e0*l / q, 1.0), -1.0) + 1) / 2 * 2), 1) * 4 + (CAST(FLOOR((ATAN2(1.4e0*k, 1.4e0*h) + 3.141592653589793) / (2 * 3.141592653589793) * 4) AS INT) % 4) AS cell FROM qbins WHERE measured AND q > 0),
    w(window_id, lo, hi) AS (VALUES (1, 1.4e0, 1.7e0), (2, 2.1e0, 2.3e0))
    SELECT volume_id, window_id, CAST(cell AS INT) AS cell, COUNT(*) AS n_core, ROUND(AVG(intensity), 6) AS core FROM c JOIN w ON q >= lo AND q < hi GROUP BY ALL""")
def _(b, v):
    h = rg.cell_heights(b, src.UB, _windows(b)).filter("n_core > 0")
    return r6(h.select("volume_id", "window_id", "cell", "n_core", "core"), "core")


@query("dom_isotropy")
def _(b, v):
    return r6(rg.isotropy(rg.cell_heights(b, src.UB, _windows(b)), cells=6), "median", "low")


@query("win_profile_peaks", """, t AS (SELECT *, LAG(value) OVER w AS a, LEAD(value) OVER w AS b, MAX(value) OVER (PARTITION BY volume_id) AS m FROM pr WHERE value IS NOT NULL WINDOW w AS (PARTITION BY volume_id ORDER BY shell))
    SELECT volume_id, shell AS top, value AS height FROM t WHERE (a IS NULL OR value > a) AND (b IS NULL OR value >= b) AND value > 0.06 * m AND value > 0""", _PROF)
def _(b, v):
    return rg.profile_peaks(sh.radial_profile(b, STEP, "median").filter("value is not null").drop("n")).select("volume_id", "top", "height")


# --- resampling, structure, features ----------------------------------------------------------------------


@query("dom_regrid", """ SELECT a.volume_id, a.ih, a.ik, a.il, (COUNT(s.intensity) = 2) AS measured, CASE WHEN COUNT(s.intensity) = 2 THEN AVG(s.intensity) ELSE 0 END AS intensity
    FROM (SELECT * FROM bins WHERE il = 5 AND ABS(ih - 10) <= 6) a LEFT JOIN bins s ON s.volume_id = a.volume_id AND s.ik = a.ik AND s.il = a.il AND s.measured
      AND s.ih IN (CAST(FLOOR((a.ih - 10) * 0.5e0) AS INT) + 10, CAST(CEIL((a.ih - 10) * 0.5e0) AS INT) + 10) WHERE (a.ih - 10) % 2 <> 0 GROUP BY a.volume_id, a.ih, a.ik, a.il""")
def _(b, v):
    t = b.filter("il = 5 and abs(ih - 10) <= 6 and (ih - 10) % 2 <> 0").select(*KEY, "h", "k", "l")
    return r6(rs.regrid(b, v, t, (0.5, 0, 0, 0, 1, 0, 0, 0, 1)), "intensity")


_SITES = [("a", 0.0, 0.0, 0.0, 1.0), ("b", 0.5, 0.5, 0.5, 2.0), ("c", 0.25, 0.0, 0.75, 3.0)]
_SITES_SQL = " si(site, x, y, z, w) AS (VALUES ('a', 0.0e0, 0.0e0, 0.0e0, 1.0e0), ('b', 0.5e0, 0.5e0, 0.5e0, 2.0e0), ('c', 0.25e0, 0.0e0, 0.75e0, 3.0e0)), df AS (SELECT a.site, b.site AS site2, ROUND(b.x - a.x - FLOOR(b.x - a.x), 9) AS x, ROUND(b.y - a.y - FLOOR(b.y - a.y), 9) AS y, ROUND(b.z - a.z - FLOOR(b.z - a.z), 9) AS z, a.w * b.w AS weight FROM si a JOIN si b ON a.site <> b.site)"


def _differences(b):
    return rs.pair_differences(b.sparkSession.createDataFrame(_SITES, "site string, x double, y double, z double, weight double"))


@query("dom_pair_signal", """, p AS (SELECT site, site2, x + a AS x, y + b AS y, z + c AS z FROM df, range(-1, 2) t1(a), range(-1, 2) t2(b), range(-1, 2) t3(c) WHERE ABS(x + a) <= 1 AND ABS(y + b) <= 1 AND ABS(z + c) <= 0.9)
    SELECT v.volume_id, site, site2, COUNT(*) AS n FROM p, (SELECT DISTINCT volume_id FROM bins) v GROUP BY ALL""", _SITES_SQL)
def _(b, v):
    p = rs.pair_vectors(_differences(b), 1).filter("abs(z) <= 0.9").select("site", "site2", F.col("x").alias("h"), F.col("y").alias("k"), F.col("z").alias("l"))
    p = b.select("volume_id").distinct().join(F.broadcast(p))  # the vectors of three sites within one cell
    return rs.at_points(b, v, p, ["site", "site2", "h", "k", "l"]).groupBy("volume_id", "site", "site2").agg(F.count("*").alias("n"))


@query("dom_colour_range")
def _(b, v):
    pdf = tr.delta_pdf(b, v, "hann").filter("not (abs(x) < 0.3 and abs(y) < 0.3 and abs(z) < 0.3)")
    return r6(pdf.filter("ix = 10 or iy = 10 or iz = 5").groupBy("volume_id").agg(F.expr("percentile(abs(value), 0.999)").alias("top")), "top")


@query("dom_compare_sections", " SELECT volume_id, COUNT(*) AS n, quantile_cont(intensity, 0.5) AS median, MAX(intensity) AS largest FROM bins WHERE il = 5 AND measured GROUP BY 1")
def _(b, v):
    s = flt.section(b, "hk0").filter("measured")
    return s.groupBy("volume_id").agg(F.count("*").alias("n"), F.expr("percentile(intensity, 0.5)").alias("median"), F.max("intensity").alias("largest"))


@query("sca_real_radius", " SELECT volume_id, ih, ik, il, ROUND(SQRT(20.25e0*h*h + 20.25e0*k*k + 36.0e0*l*l + 2 * (4.5e0 * 4.5e0 * COS(RADIANS(120.0e0))) * h * k), 6) AS r FROM bins")
def _(b, v):
    m = geo.cell_to_metric(*[F.lit(x) for x in (4.5, 4.5, 6.0, 90.0, 90.0, 120.0)])
    m = [x if i in (0, 1, 3, 4, 8) else F.lit(0.0) for i, x in enumerate(m)]
    return r6(b.select(*KEY, F.sqrt(F.greatest(geo.quadratic(m, F.col("h"), F.col("k"), F.col("l")), F.lit(0.0))).alias("r")), "r")


# --- lineage ----------------------------------------------------------------------------------------------


def _records(b):
    r = b.filter("ih < 7").select("volume_id", F.element_at(F.array(*[F.lit(s) for s in ln.STAGES]), F.col("ih") + 1).alias("stage"), F.col("ih").alias("position"), F.concat(F.lit("s"), (F.col("ik") % 3).cast("string")).alias("settings"), F.concat(F.lit("i"), (F.col("il") % 2).cast("string")).alias("input_id"), (F.col("ik") * 11 + F.col("il")).alias("made_at"))
    return r


_LIN = """ rec AS (SELECT volume_id, ih AS position, ['average', 'rings', 'punch', 'backfill', 'flatten', 'transform', 'check'][ih + 1] AS stage, 's' || (ik % 3) AS settings, 'i' || (il % 2) AS input_id, ik * 11 + il AS made_at FROM bins WHERE ih < 7),
 lst AS (SELECT volume_id, position, stage, ARG_MAX(settings, made_at) AS settings, ARG_MAX(input_id, made_at) AS input_id, MAX(made_at) AS made_at FROM rec GROUP BY ALL)"""


@query("src_latest_records", " SELECT volume_id, stage, settings, input_id, made_at FROM lst", _LIN)
def _(b, v):
    return ln.latest(_records(b))


@query("dom_staleness", """, own AS (SELECT *, CASE WHEN settings <> 's1' THEN 'settings' WHEN input_id <> 'i0' THEN 'input' END AS own FROM lst)
    SELECT volume_id, position, stage, COALESCE(own, CASE WHEN BOOL_OR(own IS NOT NULL) OVER (PARTITION BY volume_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'upstream' END) AS reason FROM own""", _LIN)
def _(b, v):
    r = _records(b)
    want = r.select("volume_id", "position", "stage").distinct().withColumn("settings", F.lit("s1")).withColumn("input_id", F.lit("i0"))
    return ln.staleness(r, want)


@query("src_catalogue", " SELECT volume_id, COUNT(*) FILTER (settings = 's1') AS n_current, COUNT(*) AS n_stages FROM lst GROUP BY 1", _LIN)
def _(b, v):
    l = ln.latest(_records(b))
    return b.select("volume_id").distinct().join(l, "volume_id", "left").groupBy("volume_id").agg(F.count_if(F.col("settings") == "s1").alias("n_current"), F.count("stage").alias("n_stages"))
