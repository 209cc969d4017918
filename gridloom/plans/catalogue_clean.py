"""Registered queries of the cleaning stages and their quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import cleaning as cl
from .catalogue import _PUNCH, _SECTOR, _SH, KEY, STEP, _holes
from .registry import flt, lat, query, r6, sh, src, tr


def _ring_shells(b):
    return b.select("volume_id").distinct().withColumn("shell", F.explode(F.array(F.lit(5), F.lit(6))))


_POOL = _SH + f""", sp AS (SELECT volume_id, ih, {_SECTOR.format(n=8)} AS sector, shell, quantile_cont(intensity, 0.5) AS median, COUNT(*) AS n FROM s WHERE measured GROUP BY ALL),
 ex AS (SELECT volume_id, ih + a AS ih, (((sector + b) % 8) + 8) % 8 AS sector, shell, median AS v, n * (1 - ABS(a) / 2.0e0) * (1 - ABS(b) / 2.0e0) AS w FROM sp, range(-1, 2) t1(a), range(-1, 2) t2(b)),
 cum AS (SELECT *, SUM(w) OVER (PARTITION BY volume_id, ih, sector, shell ORDER BY v) AS c, SUM(w) OVER (PARTITION BY volume_id, ih, sector, shell) AS t FROM ex),
 wm AS (SELECT volume_id, ih, sector, shell, MIN(v) AS median, MAX(t) AS weight FROM cum WHERE 2 * c >= t GROUP BY ALL)"""


@query("win_pooled_profiles", " SELECT volume_id, CAST(ih AS INT) AS ih, CAST(sector AS INT) AS sector, shell, CASE WHEN weight >= 6 THEN median END AS median FROM wm SEMI JOIN sp USING (volume_id, ih, sector, shell)", _POOL)
def _(b, v):
    p = cl.pooled_profiles(b, "h", STEP, 8)
    return p.select("volume_id", "ih", F.col("sector").cast("int").alias("sector"), "shell", "median")


@query("dom_pooled_rings")
def _(b, v):
    return r6(cl.remove_rings(b, "h", _ring_shells(b), STEP).select(*KEY, "intensity", "removed"), "intensity", "removed")


@query("dom_ring_models", " SELECT volume_id, shell, model, COUNT(*) AS n FROM s, (SELECT UNNEST(['raw', 'pooled']) AS model) WHERE measured AND ih = 10 GROUP BY ALL", _SH)
def _(b, v):
    one = cl.remove_rings(b, "h", _ring_shells(b), STEP).drop("removed")
    both = b.withColumn("model", F.lit("raw")).unionByName(one.withColumn("model", F.lit("pooled")))
    return both.filter("measured and ih = 10").groupBy("volume_id", sh.shell(F.col("q"), 0.0, STEP).alias("shell"), "model").agg(F.count("*").alias("n"))


@query("dom_share_ring_removal")
def _(b, v):
    return r6(cl.share_over_orbits(cl.remove_rings(b, "h", _ring_shells(b), STEP), v, lat.MMM, "removed"), "removed")


@query("dom_laplace_fill")
def _(b, v):
    return r6(cl.laplace_fill(b, lat.components(_holes(b))), "fill")


@query("dom_hole_rings", """, d AS (SELECT volume_id, ih + a AS ih, ik + b AS ik, il + c AS il, MIN(GREATEST(ABS(a), ABS(b), ABS(c))) AS distance FROM hol, range(-2, 3) t1(a), range(-2, 3) t2(b), range(-2, 3) t3(c) GROUP BY ALL)
    SELECT volume_id, CAST(distance AS INT) AS distance, quantile_cont(bins.intensity, 0.5) AS median, ROUND(quantile_cont(bins.intensity, 0.9), 6) AS p90, COUNT(*) AS n FROM d JOIN bins USING (volume_id, ih, ik, il) WHERE distance > 0 AND measured GROUP BY ALL""", _PUNCH)
def _(b, v):
    return r6(cl.hole_rings(b, _holes(b), 2), "p90")


@query("dom_hole_census", """, r AS (SELECT volume_id, COUNT(*) AS n_bins FROM hol GROUP BY 1) SELECT volume_id, n_bins FROM r""", _PUNCH)
def _(b, v):
    c = lat.region_census(lat.components(_holes(b)))
    return c.groupBy("volume_id").agg(F.sum("n").alias("n_bins"))


@query("dom_checkerboard", """, x AS (SELECT volume_id, ih, ik, SIGN(intensity - m) AS s FROM bins JOIN (SELECT volume_id, quantile_cont(intensity, 0.5) AS m FROM bins WHERE measured AND il = 5 GROUP BY 1) USING (volume_id) WHERE measured AND il = 5)
    SELECT a.volume_id, ROUND(AVG(CAST(a.s <> b.s AS INT)), 6) AS alternating, COUNT(*) AS n FROM x a JOIN x b ON b.volume_id = a.volume_id AND b.ih = a.ih + 1 AND b.ik = a.ik WHERE a.s <> 0 AND b.s <> 0 GROUP BY 1""")
def _(b, v):
    return r6(cl.checkerboard(flt.section(b, "hk0").filter("measured"), "ih", "ik"), "alternating")


@query("dom_azimuthal_texture", f""", g AS (SELECT volume_id, shell, {_SECTOR.format(n=8)} AS sector, AVG(intensity) AS m FROM s WHERE measured GROUP BY ALL)
    SELECT volume_id, shell, ROUND(STDDEV_POP(m) / AVG(m), 6) AS texture, COUNT(*) AS n FROM g GROUP BY ALL""", _SH)
def _(b, v):
    return r6(cl.azimuthal_texture(b, "h", STEP), "texture")


@query("dom_score_components", """, x AS (SELECT b.volume_id, b.intensity * 0.25 AS bragg, b.intensity * 0.75 AS diffuse, h.intensity IS NOT NULL AS punched FROM bins b LEFT JOIN hol h USING (volume_id, ih, ik, il))
    SELECT volume_id, ROUND(SUM(CASE WHEN NOT punched THEN bragg ELSE 0 END) / SUM(bragg), 6) AS bragg_left, ROUND(SUM(CASE WHEN punched THEN diffuse ELSE 0 END) / SUM(diffuse), 6) AS diffuse_removed,
      ROUND(AVG(CASE WHEN punched THEN 100 - diffuse END), 6) AS fill_bias FROM x GROUP BY 1""", _PUNCH)
def _(b, v):
    h = _holes(b).select(*KEY, F.lit(True).alias("p"))
    p = b.join(h, KEY, "left").select(*KEY, F.coalesce("p", F.lit(False)).alias("punched"))
    s = cl.score_components(p, b.select(*KEY, F.lit(100.0).alias("fill")), b.select(*KEY, (F.col("intensity") * 0.75).alias("diffuse")), b.select(*KEY, (F.col("intensity") * 0.25).alias("bragg")))
    return r6(s, "bragg_left", "diffuse_removed", "fill_bias")


@query("agg_bootstrap", """, bl AS (SELECT ih % 7 AS block, SUM(intensity) AS num, SUM(sigma) AS den FROM bins WHERE measured GROUP BY 1), dr AS (SELECT r AS replicate, b AS block, (r * 5 + b * 3 + r * b) % 3 + 1 AS times FROM range(20) t1(r), range(7) t2(b)),
    g AS (SELECT replicate, SUM(times * num) / SUM(times * den) AS ratio FROM bl JOIN dr USING (block) GROUP BY 1) SELECT ROUND(AVG(ratio), 5) AS mean, ROUND(STDDEV_SAMP(ratio), 5) AS se, COUNT(*) AS replicates FROM g""")
def _(b, v):
    bl = b.filter("measured").groupBy((F.col("ih") % 7).alias("block")).agg(F.sum("intensity").alias("num"), F.sum("sigma").alias("den"))
    dr = b.sparkSession.range(20).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(6)))).select(F.col("id").alias("replicate"), "block", ((F.col("id") * 5 + F.col("block") * 3 + F.col("id") * F.col("block")) % 3 + 1).alias("times"))
    return cl.bootstrap(bl, dr).select(F.round("mean", 5).alias("mean"), F.round("se", 5).alias("se"), "replicates")


@query("dom_section_metrics", """, x AS (SELECT volume_id, h AS x, k AS y, intensity - 100 AS value FROM bins WHERE measured AND il = 5), m AS (SELECT volume_id, quantile_cont(ABS(value), 0.5) AS m FROM x GROUP BY 1),
    g AS (SELECT volume_id, AVG(CAST(value > 0 AS INT)) AS positive, AVG(CAST(ABS(value) > 3 * 1.4826e0 * m AS INT)) AS strong, SUM(ABS(value)*x*x)/SUM(ABS(value)) AS xx, SUM(ABS(value)*y*y)/SUM(ABS(value)) AS yy, SUM(ABS(value)*x*y)/SUM(ABS(value)) AS xy FROM x JOIN m USING (volume_id) GROUP BY 1)
    SELECT volume_id, ROUND(positive, 6) AS positive, ROUND(strong, 6) AS strong, ROUND(1 - (xx + yy - SQRT((xx-yy)**2 + 4*xy*xy)) / (xx + yy + SQRT((xx-yy)**2 + 4*xy*xy)), 6) AS anisotropy FROM g""")
def _(b, v):
    s = flt.section(b, "hk0").filter("measured").select("volume_id", F.col("h").alias("x"), F.col("k").alias("y"), (F.col("intensity") - 100).alias("value"))
    return r6(cl.section_metrics(s), "positive", "strong", "anisotropy")


@query("dom_feature_groups")
def _(b, v):
    return r6(cl.grouped_features(tr.strongest(tr.delta_pdf(b, v, "hann"), 3.0)), "strongest", "length")
