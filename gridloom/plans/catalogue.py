"""The registered queries: one for each operator, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import STEP, flt, geo, lat, query, r6, sh, src, tr

KEY = ["volume_id", "ih", "ik", "il"]
SHELL = f"CAST(FLOOR(q / {STEP}) AS INT)"
VALS = "volume_id, ih, ik, il"

# --- sources ----------------------------------------------------------------------------------------------


@query("src_bins", f"SELECT {VALS}, h, k, l, intensity, ROUND(sigma, 6) AS sigma, measured FROM bins")
def _(b, v):
    return r6(b.select(*src.BIN_COLUMNS), "sigma")


@query(
    "src_load_rule",
    f"SELECT {VALS}, CASE WHEN measured THEN intensity ELSE 0 END AS intensity,"
    " CASE WHEN measured THEN ROUND(CASE WHEN il % 2 = 0 THEN sigma ELSE SQRT(ABS(intensity)) END, 6) ELSE 0 END AS sigma,"
    " measured, (measured AND il % 2 = 1) AS sigma_estimated FROM bins",
)
def _(b, v):
    raw = b.select(
        *KEY, F.when(F.col("measured") | (F.col("ih") % 2 == 0), F.col("intensity")).otherwise(float("nan")).alias("signal"),
        F.when(F.col("il") % 2 == 0, F.col("sigma") ** 2).alias("errors_squared"), (~F.col("measured")).cast("int").alias("mask"),
    )
    return r6(src.load(raw), "sigma")


@query(
    "src_edge_centres",
    " SELECT volume_id, 'h' AS axis, ih AS idx, ROUND(h, 6) AS centre FROM (SELECT DISTINCT volume_id, ih, h FROM bins) WHERE ih < 20",
)
def _(b, v):
    e = b.select("volume_id", "ih", "h").distinct().groupBy("volume_id").agg(F.array_sort(F.collect_set(F.round(F.col("h") - 0.1, 9))).alias("edges"))
    return r6(src.centres(e.withColumn("axis", F.lit("h"))), "centre")


@query(
    "src_volume_attributes",
    " SELECT DISTINCT volume_id, 4.488::DOUBLE AS a, 90.0::DOUBLE AS gamma FROM bins",
)
def _(b, v):
    return b.select("volume_id").distinct().join(v, "volume_id").select(
        "volume_id", F.col("attrs")["a"].cast("double").alias("a"), F.coalesce(F.try_element_at("attrs", F.lit("gamma")).cast("double"), F.lit(90.0)).alias("gamma")
    )


@query(
    "src_sigma_note",
    " SELECT volume_id, MAX(intensity) AS largest, FALSE AS fractional, MAX(intensity) < 1 AS normalised FROM bins WHERE measured GROUP BY 1",
)
def _(b, v):
    return src.sigma_note(b)


@query(
    "dom_volume_summary",
    " SELECT volume_id, 21 AS nh, 21 AS nk, 11 AS nl, COUNT(*) AS n, COUNT(*) FILTER (measured) AS n_measured, MIN(h) AS h_min, MAX(h) AS h_max FROM bins GROUP BY 1",
)
def _(b, v):
    g = b.groupBy("volume_id").agg(F.count("*").alias("n"), F.count_if("measured").alias("n_measured"), F.min("h").alias("h_min"), F.max("h").alias("h_max"))
    return g.join(v.select("volume_id", "nh", "nk", "nl"), "volume_id")


# --- filters ----------------------------------------------------------------------------------------------


@query("flt_measured", f"SELECT {VALS}, intensity FROM bins WHERE measured")
def _(b, v):
    return b.filter(flt.measured()).select(*KEY, "intensity")


@query("flt_q_magnitude", f"SELECT {VALS}, ROUND(q, 6) AS q FROM qbins")
def _(b, v):
    return r6(b.select(*KEY, "q"), "q")


@query("flt_q_band", f"SELECT {VALS}, CASE WHEN q BETWEEN 0.8 AND 2.2 THEN intensity ELSE 0 END AS intensity, measured AND q BETWEEN 0.8 AND 2.2 AS measured FROM qbins")
def _(b, v):
    return flt.q_band(b, 0.8, 2.2).select(*KEY, "intensity", "measured")


@query("flt_crop", f"SELECT {VALS}, intensity FROM bins WHERE ABS(h) <= 1 AND ABS(k) <= 1 AND ABS(l) <= 0.6")
def _(b, v):
    return flt.crop(b, 1, 1, 0.6).select(*KEY, "intensity")


@query("flt_section_hk0", f"SELECT {VALS}, intensity FROM bins WHERE il = 6")
def _(b, v):
    return flt.section(b, "hk0", 0.23).select(*KEY, "intensity")


@query(
    "flt_section_between",
    """ SELECT volume_id, ih, ik, ROUND(SUM(w * intensity) / SUM(w), 6) AS value
    FROM (SELECT *, CASE WHEN il = 6 THEN 0.75 ELSE 0.25 END AS w FROM bins WHERE measured AND il IN (6, 7)) GROUP BY 1, 2, 3""",
)
def _(b, v):
    return r6(flt.section_between(b, "hk0", 0.25), "value")


@query(
    "flt_line_profile",
    """, pts AS (SELECT range AS point, -1.0 + 0.1e0 * range AS x FROM range(21)),
    c AS (SELECT point, CAST(FLOOR((x + 2.0) / 0.2 + 1e-9) AS INT) + c AS ih,
      CASE WHEN c = 1 THEN GREATEST((x + 2.0) / 0.2 - FLOOR((x + 2.0) / 0.2 + 1e-9), 0) ELSE 1 - GREATEST((x + 2.0) / 0.2 - FLOOR((x + 2.0) / 0.2 + 1e-9), 0) END AS w
      FROM pts, (SELECT UNNEST([0, 1]) AS c)),
    g AS (SELECT v.volume_id, point, c.ih, w, intensity FROM c, (SELECT DISTINCT volume_id FROM bins) v
      LEFT JOIN bins b ON b.volume_id = v.volume_id AND b.ih = c.ih AND b.ik = 10 AND b.il = 5 AND measured WHERE w > 1e-9)
    SELECT volume_id, CAST(point AS INT) AS point,
      CASE WHEN COUNT(intensity) = COUNT(*) THEN ROUND(SUM(w * intensity) / SUM(w), 6) END AS value FROM g GROUP BY 1, 2""",
)
def _(b, v):
    return r6(flt.line_profile(b, (-1.0, 0.0, 0.0), (1.0, 0.0, 0.0), 21, (-2.0, -2.0, -1.0), (0.2, 0.2, 0.2)), "value")


def _rings(b):
    return b.sparkSession.createDataFrame([(0.7, 0.9), (1.6, 1.75)], "q_lo double, q_hi double")


@query("flt_ring_mask", f"SELECT {VALS} FROM qbins WHERE NOT (q BETWEEN 0.7 AND 0.9 OR q BETWEEN 1.6 AND 1.75)")
def _(b, v):
    return flt.ring_mask(b, _rings(b)).select(*KEY)


@query(
    "flt_near_node",
    f"""SELECT {VALS} FROM bins WHERE SQRT((1.4e0*(h - ROUND_EVEN(h, 0)))**2 + (1.4e0*(k - ROUND_EVEN(k, 0)))**2 + (1.2e0*(l - ROUND_EVEN(l, 0)))**2) <= 0.35""",
)
def _(b, v):
    return b.filter(flt.near_node((1, 1, 1), src.UB, 0.35)).select(*KEY)


_POSITIONS = [(1, 1, 0, 0, 0.5, 0.05, 1.0), (2, 0, 1, 0, 0.25, 0.06, 0.5), (3, 1, 1, 0, 0.0, 0.1, 1.0)]
_POS_SQL = """ pos(position_id, fh, fk, fl, c, w, p) AS (VALUES (1, 1, 0, 0, 0.5e0, 0.05e0, 1.0e0), (2, 0, 1, 0, 0.25e0, 0.06e0, 0.5e0), (3, 1, 1, 0, 0.0e0, 0.1e0, 1.0e0)),
 posd AS (SELECT b.*, position_id, ABS(((fh*h + fk*k + fl*l - c + p/2) - p * FLOOR((fh*h + fk*k + fl*l - c + p/2) / p)) - p/2) AS d, w FROM bins b, pos)"""


def _positions(b):
    return b.sparkSession.createDataFrame(_POSITIONS, "position_id int, fh int, fk int, fl int, centre double, half double, period double")


@query("flt_protected", f" SELECT {VALS}, MIN(position_id) FILTER (d <= w + 1e-9) AS position_id FROM posd GROUP BY ALL", _POS_SQL)
def _(b, v):
    p = _positions(b).withColumn("half", F.col("half") + 1e-9)
    return flt.protected(b, p).select(*KEY, "position_id")


@query(
    "flt_nearest_position",
    " SELECT volume_id, ih, ik, ROUND(MIN(d), 6) AS distance FROM posd WHERE il = 5 AND measured GROUP BY ALL", _POS_SQL,
)
def _(b, v):
    p = b.filter("il = 5 and measured").select("volume_id", "ih", "ik", "h", "k", "l")
    return r6(flt.nearest_position(p, _positions(b)).select("volume_id", "ih", "ik", "distance"), "distance")


@query(
    "flt_capsule",
    f""", c AS (SELECT *, LEAST(1, GREATEST(-1, (4 * h * 0.4e0 + 4 * k * 0.4e0) / (4 * 0.16e0 + 4 * 0.16e0))) AS t FROM bins)
    SELECT {VALS} FROM c WHERE 4 * (h - t * 0.4e0)**2 + 4 * (k - t * 0.4e0)**2 + 9 * l**2 <= 1.0000001""",
)
def _(b, v):
    d = [F.col(a) / 1.00000005 for a in "hkl"]
    return b.filter(geo.capsule_inside(d, (4, 0, 0, 0, 4, 0, 0, 0, 9), (0.4 / 1.00000005, 0.4 / 1.00000005, 0))).select(*KEY)


# --- joins ------------------------------------------------------------------------------------------------

_AN = "SELECT a.ih, a.ik, a.il, a.intensity AS x, a.sigma AS sx, a.measured AS mx, n.intensity AS y, n.sigma AS sy, n.measured AS my, a.q FROM qbins a JOIN qbins n USING (ih, ik, il) WHERE a.volume_id = 'A' AND n.volume_id = 'N'"


@query("jon_same_axes", " SELECT 'h' AS axis, COUNT(*) AS n, TRUE AS same FROM (SELECT DISTINCT ih FROM bins WHERE volume_id = 'A') JOIN (SELECT DISTINCT ih FROM bins WHERE volume_id = 'N') USING (ih)")
def _(b, v):
    a, n = (b.filter(F.col("volume_id") == x).select("ih", F.col("h").alias(x)).distinct() for x in "AN")
    j = a.join(n, "ih", "full")
    return j.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.abs(F.col("A") - F.col("N")) <= 2e-4, F.lit(False))).alias("same")).withColumn("axis", F.lit("h"))


@query("jon_subtract_empty", f" SELECT ih, ik, il, x - 0.5 * y AS intensity, ROUND(SQRT(sx**2 + 0.25 * sy**2), 6) AS sigma, mx AND my AS measured FROM ({_AN})")
def _(b, v):
    a, n = (b.filter(F.col("volume_id") == x) for x in "AN")
    return r6(lat.pair_combine(a, n, 0.5).select("ih", "ik", "il", "intensity", "sigma", "measured"), "sigma")


@query(
    "jon_empty_scale",
    f""", j AS ({_AN}), w AS (SELECT * FROM j WHERE mx AND my AND q BETWEEN 0.5 AND 2.5), t AS (SELECT quantile_cont(y, 0.99) AS top FROM w)
    SELECT 'A' AS volume_id, COUNT(*) AS n, ROUND(CASE WHEN COUNT(*) >= 10 THEN SUM(x * y) / SUM(y * y) ELSE 1 END, 6) AS scale FROM w, t WHERE y <= top""",
)
def _(b, v):
    a, n = (b.filter(F.col("volume_id") == x) for x in "AN")
    return r6(lat.empty_scale(a, n, 0.5, 2.5), "scale")


@query("jon_orbit_images", """ SELECT volume_id, ih, ik, il, COUNT(DISTINCT (gh, gk, gl)) AS n_images FROM (
    SELECT *, 10 + a * (ih - 10) AS gh, 10 + b * (ik - 10) AS gk, 5 + c * (il - 5) AS gl FROM bins, (SELECT UNNEST([1, -1]) AS a), (SELECT UNNEST([1, -1]) AS b), (SELECT UNNEST([1, -1]) AS c)) GROUP BY ALL""")
def _(b, v):
    return lat.images(b.select(*KEY), v, lat.MMM).groupBy(*KEY).agg(F.countDistinct("gh", "gk", "gl").alias("n_images"))


@query("jon_mirror", " SELECT a.volume_id, a.ih, a.ik, a.il, a.intensity AS x, m.intensity AS y FROM bins a JOIN bins m ON m.volume_id = a.volume_id AND m.ih = 20 - a.ih AND m.ik = 20 - a.ik AND m.il = 10 - a.il WHERE a.measured AND m.measured")
def _(b, v):
    return lat.mirror_pairs(b, v)


_WINDOW = """ win AS (SELECT *, CAST(ROUND_EVEN(h, 0) AS INT) AS nh, CAST(ROUND_EVEN(k, 0) AS INT) AS nk, CAST(ROUND_EVEN(l, 0) AS INT) AS nl FROM qbins WHERE measured),
 nod AS (SELECT * FROM win WHERE ABS(h - nh) <= 0.3 AND ABS(k - nk) <= 0.3 AND ABS(l - nl) <= 0.3 AND NOT (nh = 0 AND nk = 0 AND nl = 0)),
 npk AS (SELECT volume_id, nh, nk, nl, MAX(intensity) AS peak, quantile_cont(intensity, 0.5) AS median, COUNT(*) AS n FROM nod GROUP BY ALL)"""


@query("jon_node_windows", " SELECT volume_id, nh, nk, nl, COUNT(*) AS n, SUM(intensity) AS total FROM nod GROUP BY ALL", _WINDOW)
def _(b, v):
    return lat.nodes(b).groupBy("volume_id", "nh", "nk", "nl").agg(F.count("*").alias("n"), F.sum("intensity").alias("total"))


@query("win_brightest_of_node", """ SELECT volume_id, nh, nk, nl, ih, ik, il, intensity AS peak FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, nh, nk, nl ORDER BY intensity DESC, ih, ik, il) AS r FROM nod) WHERE r = 1""", _WINDOW)
def _(b, v):
    return lat.node_peaks(lat.nodes(b)).select("volume_id", "nh", "nk", "nl", "ih", "ik", "il", "peak")


@query("dom_node_test_floors", " SELECT volume_id, nh, nk, nl, peak, median, (peak >= 1.4 * median AND peak - median >= 20 AND n >= 3) AS is_peak FROM npk", _WINDOW)
def _(b, v):
    p = lat.node_peaks(lat.nodes(b))
    return p.select("volume_id", "nh", "nk", "nl", "peak", "median", ((F.col("peak") >= 1.4 * F.col("median")) & (F.col("peak") - F.col("median") >= 20) & (F.col("n") >= 3)).alias("is_peak"))


_PUNCH = _WINDOW + """, top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, nh, nk, nl ORDER BY intensity DESC, ih, ik, il) AS r FROM nod) JOIN npk USING (volume_id, nh, nk, nl) WHERE r = 1 AND intensity >= 1.3 * median),
 off AS (SELECT a, b, c FROM range(-1, 2) t1(a), range(-1, 2) t2(b), range(-1, 2) t3(c) WHERE a*a + b*b + c*c <= 1),
 hit AS (SELECT DISTINCT volume_id, ih + a AS ih, ik + b AS ik, il + c AS il FROM top, off),
 hol AS (SELECT volume_id, ih, ik, il, intensity FROM bins SEMI JOIN hit USING (volume_id, ih, ik, il) WHERE measured)"""


def _holes(b):
    p = lat.node_peaks(lat.nodes(b)).filter("peak >= 1.3 * median")
    return lat.punch(b, p, (1, 1, 1)).filter("punched")


@query("dom_punch", f" SELECT {VALS} FROM hol", _PUNCH)
def _(b, v):
    return _holes(b).select(*KEY)


@query("set_orbit_closure", """ SELECT DISTINCT volume_id, 10 + a * (ih - 10) AS ih, 10 + b * (ik - 10) AS ik, 5 + c * (il - 5) AS il
    FROM hol, (SELECT UNNEST([1, -1]) AS a), (SELECT UNNEST([1, -1]) AS b), (SELECT UNNEST([1, -1]) AS c)""", _PUNCH)
def _(b, v):
    m = lat.orbit_closure(_holes(b), v, lat.MMM)
    return m.select("volume_id", *[F.col(c).cast("long").alias(c) for c in KEY[1:]])


@query("set_union_of_masks", f" SELECT {VALS}, MIN(code) AS code FROM (SELECT {VALS}, 1 AS code FROM hol UNION ALL SELECT {VALS}, 2 FROM bins WHERE measured AND intensity >= 350) GROUP BY ALL", _PUNCH)
def _(b, v):
    two = b.filter("measured and intensity >= 350").select(*KEY, F.lit(2).alias("code"))
    return _holes(b).select(*KEY, F.lit(1).alias("code")).unionByName(two).groupBy(*KEY).agg(F.min("code").alias("code"))


# --- shells -----------------------------------------------------------------------------------------------

_SH = f" s AS (SELECT *, {SHELL} AS shell FROM qbins)"
_FLOORS = _SH + """, fl AS (SELECT volume_id, shell, COUNT(*) FILTER (measured) AS n_measured, COUNT(*) AS n, quantile_cont(intensity, 0.25) FILTER (measured) AS f0,
   quantile_cont(intensity, 0.5) FILTER (measured) AS median, AVG(q) FILTER (measured) AS q FROM s GROUP BY ALL),
 flo AS (SELECT *, CASE WHEN n_measured >= 20 THEN f0 END AS floor FROM fl),
 fit AS (SELECT *, q * q AS x, CAST(n_measured AS DOUBLE) AS w FROM flo WHERE floor IS NOT NULL AND q BETWEEN 0.5 AND 3.0),
 sums AS (SELECT volume_id, SUM(w) AS w, SUM(w*x) AS x, SUM(w*x*x) AS xx, SUM(w*floor) AS y, SUM(w*x*floor) AS xy, SUM(w*floor*floor) AS yy FROM fit GROUP BY 1),
 co AS (SELECT *, (w*xy - x*y) / (w*xx - x*x) AS slope, (y - (w*xy - x*y) / (w*xx - x*x) * x) / w AS const FROM sums),
 flat AS (SELECT s.*, CASE WHEN measured THEN intensity - (const + slope * LEAST(q, 3.0)**2) ELSE intensity END AS less FROM s JOIN co USING (volume_id))"""


@query("agg_shell_index", f" SELECT {VALS}, shell FROM s", _SH)
def _(b, v):
    return b.select(*KEY, sh.shell(F.col("q"), 0.0, STEP).alias("shell"))


@query("agg_q_range", " SELECT volume_id, ROUND(MIN(q), 6) AS q_min, ROUND(MAX(q), 6) AS q_max FROM qbins WHERE measured GROUP BY 1")
def _(b, v):
    return r6(sh.measured_q_range(b), "q_min", "q_max")


@query("agg_radial_profile", " SELECT volume_id, shell, CASE WHEN COUNT(*) >= 3 THEN ROUND(AVG(intensity), 6) END AS value, COUNT(*) AS n FROM s WHERE measured GROUP BY ALL", _SH)
def _(b, v):
    return r6(sh.radial_profile(b, STEP), "value")


@query("agg_median_profile", " SELECT volume_id, shell, CASE WHEN COUNT(*) >= 3 THEN quantile_cont(intensity, 0.5) END AS value, COUNT(*) AS n FROM s WHERE measured GROUP BY ALL", _SH)
def _(b, v):
    return sh.radial_profile(b, STEP, "median")


_STATS = _SH + """, m AS (SELECT volume_id, shell, quantile_cont(intensity, 0.5) AS median, COUNT(*) AS n, STDDEV_POP(intensity) AS sd FROM s WHERE measured GROUP BY ALL),
 d AS (SELECT volume_id, shell, quantile_cont(ABS(intensity - median), 0.5) AS mad FROM s JOIN m USING (volume_id, shell) WHERE measured GROUP BY ALL),
 st AS (SELECT volume_id, shell, n, CASE WHEN n >= 8 THEN median END AS median, CASE WHEN n < 8 THEN NULL WHEN mad > 0 THEN 1.4826e0 * mad WHEN sd > 0 THEN sd ELSE 1 END AS scale FROM m JOIN d USING (volume_id, shell))"""


@query("agg_robust_shell_stats", " SELECT volume_id, shell, n, median, ROUND(scale, 6) AS scale FROM st", _STATS)
def _(b, v):
    return r6(sh.shell_stats(b, STEP), "scale")


@query("agg_shell_thresholds", " SELECT volume_id, shell, ROUND(GREATEST(27.0, median + 4 * scale), 6) AS threshold FROM st WHERE median IS NOT NULL", _STATS)
def _(b, v):
    return r6(sh.shell_thresholds(sh.shell_stats(b, STEP).filter("median is not null"), 4.0, 27.0).select("volume_id", "shell", "threshold"), "threshold")


@query("agg_diffuse_scatter", """ SELECT volume_id, ROUND(MIN(scale), 6) AS scatter FROM (SELECT *, SUM(n) OVER (PARTITION BY volume_id ORDER BY scale, shell) AS c, SUM(n) OVER (PARTITION BY volume_id) AS t
    FROM st WHERE scale IS NOT NULL) WHERE 2 * c >= t GROUP BY 1""", _STATS)
def _(b, v):
    return r6(sh.diffuse_scatter(sh.shell_stats(b, STEP)), "scatter")


@query("agg_shell_floors", " SELECT volume_id, shell, n_measured, n, floor, median FROM flo", _FLOORS)
def _(b, v):
    return sh.shell_floors(b, STEP).drop("q")


@query("agg_shell_floors_by_rank", " SELECT volume_id, shell, n_measured, ROUND(f0, 6) AS floor FROM fl WHERE n_measured > 0", _FLOORS)
def _(b, v):
    return r6(sh.ranked_floors(b, STEP), "floor")


@query("agg_trimmed_profile", """, p AS (SELECT volume_id, shell, quantile_cont(intensity, 0.1) AS lo, quantile_cont(intensity, 0.9) AS hi, COUNT(*) AS n FROM s WHERE measured GROUP BY ALL)
    SELECT volume_id, shell, CASE WHEN MAX(n) >= 5 THEN ROUND(AVG(intensity) FILTER (intensity BETWEEN lo AND hi), 6) END AS value, MAX(n) AS n FROM s JOIN p USING (volume_id, shell) WHERE measured GROUP BY ALL""", _SH)
def _(b, v):
    return r6(sh.trimmed_profile(b, STEP), "value")


_SECTOR = "CAST(((CAST(FLOOR((ATAN2(l, k) + 3.141592653589793) / (2 * 3.141592653589793) * {n}) AS INT) % {n}) + {n}) % {n} AS INT)"


@query("agg_sector_profiles", f" SELECT volume_id, ih, {_SECTOR.format(n=8)} AS sector, shell, quantile_cont(intensity, 0.5) AS median, COUNT(*) AS n FROM s WHERE measured GROUP BY ALL", _SH)
def _(b, v):
    return sh.sector_profiles(b, "h", STEP)


@query("agg_across_stack", """ SELECT volume_id, shell, quantile_cont(m, 0.5) AS median, COUNT(*) AS n_planes FROM (SELECT volume_id, ih, shell, quantile_cont(intensity, 0.5) AS m, COUNT(*) AS n
    FROM s WHERE measured GROUP BY ALL) WHERE n >= 8 GROUP BY ALL""", _SH)
def _(b, v):
    return sh.across_stack(b, "h", STEP)


@query("agg_coverage", f""", g AS (SELECT volume_id, a.range AS ih, b.range AS ik, c.range AS il, SQRT((1.4e0*((a.range - 10)::DOUBLE/5))**2 + (1.4e0*((b.range - 10)::DOUBLE/5))**2 + (1.2e0*((c.range - 5)::DOUBLE/5))**2) AS q
      FROM (SELECT DISTINCT volume_id FROM bins), range(21) a, range(21) b, range(11) c)
    SELECT volume_id, CAST(FLOOR(q / {STEP}) AS INT) AS shell, COUNT(*) AS n, COUNT(*) FILTER (measured) AS n_measured, COUNT(*) FILTER (measured AND intensity <> 0) AS n_counted,
      ROUND(COUNT(*) FILTER (measured) / COUNT(*), 6) AS share FROM g LEFT JOIN bins USING (volume_id, ih, ik, il) GROUP BY 1, 2 HAVING COUNT(*) >= 50""")
def _(b, v):
    return r6(sh.coverage(b, v, STEP), "share")


@query("agg_slice_summary", """, x AS (SELECT volume_id, intensity - 150 AS value FROM bins WHERE measured AND il = 5), m AS (SELECT volume_id, quantile_cont(value, 0.5) AS md FROM x GROUP BY 1)
    SELECT volume_id, COUNT(*) AS n, MAX(md) AS median, ROUND(1.4826e0 * quantile_cont(ABS(value - md), 0.5), 6) AS spread, ROUND(quantile_cont(value, 0.01), 6) AS p01, ROUND(quantile_cont(value, 0.99), 6) AS p99,
      MIN(value) AS least, MAX(value) AS largest, ROUND(AVG(CASE WHEN value < 0 THEN 1.0 ELSE 0 END), 6) AS negative FROM x JOIN m USING (volume_id) GROUP BY 1""")
def _(b, v):
    x = b.filter("measured and il = 5").select("volume_id", (F.col("intensity") - 150).alias("value"))
    return r6(sh.slice_summary(x, ["volume_id"]), "spread", "p01", "p99", "negative")


@query("agg_undersampled", f""", t AS (SELECT *, {_SECTOR.format(n=12)} AS cell FROM s), c AS (SELECT volume_id, ih, shell, cell, COUNT(*) AS n FROM t WHERE measured GROUP BY ALL),
    md AS (SELECT volume_id, ih, shell, quantile_cont(n, 0.5) AS m FROM c GROUP BY ALL)
    SELECT volume_id, ih, ik, il, COALESCE(n >= 0.25 * m, FALSE) AS sampled FROM t LEFT JOIN c USING (volume_id, ih, shell, cell) LEFT JOIN md USING (volume_id, ih, shell)""", _SH)
def _(b, v):
    return sh.undersampled(b, "h", STEP).select(*KEY, "sampled")


@query("agg_azimuthal_map", f" SELECT volume_id, {_SECTOR.format(n=24)} AS phi, ROUND(AVG(intensity), 6) AS mean, COUNT(*) AS n FROM qbins WHERE measured AND ih = 10 AND q BETWEEN 0.8 AND 1.4 GROUP BY ALL")
def _(b, v):
    phi = F.pmod(F.floor((F.atan2("l", "k") + 3.141592653589793) / (2 * 3.141592653589793) * 24), F.lit(24)).cast("int")
    return r6(b.filter("measured and ih = 10 and q between 0.8 and 1.4").groupBy("volume_id", phi.alias("phi")).agg(F.avg("intensity").alias("mean"), F.count("*").alias("n")), "mean")


@query("agg_weighted_counts", " SELECT v.volume_id, r.range AS key, COALESCE(SUM(intensity), 0) AS total FROM (SELECT DISTINCT volume_id FROM bins) v CROSS JOIN range(30) r LEFT JOIN bins b ON b.volume_id = v.volume_id AND b.ih + 2 = r.range GROUP BY ALL")
def _(b, v):
    every = b.select("volume_id").distinct().withColumn("key", F.explode(F.expr("sequence(0L, 29L)")))
    g = b.groupBy("volume_id", (F.col("ih") + 2).cast("long").alias("key")).agg(F.sum("intensity").alias("total"))
    return every.join(g, ["volume_id", "key"], "left").fillna(0.0, ["total"])


@query("agg_pedestal_fit", " SELECT volume_id, ROUND(const, 5) AS const, ROUND(slope, 5) AS slope, ROUND(1 - (yy - const * y - slope * xy) / (yy - y * y / w), 5) AS r2 FROM co", _FLOORS)
def _(b, v):
    f = sh.fit_pedestal(sh.shell_floors(b, STEP), 0.5, 3.0)
    return f.select("volume_id", *[F.round(c, 5).alias(c) for c in ("const", "slope", "r2")])


@query("flagship_flatten", " SELECT volume_id, shell, COUNT(*) FILTER (measured) AS n_measured, ROUND(MIN(f.floor), 4) AS floor_before, ROUND(quantile_cont(less, 0.25) FILTER (measured), 4) AS floor_after FROM flat JOIN (SELECT volume_id, shell, floor FROM flo WHERE floor IS NOT NULL) f USING (volume_id, shell) GROUP BY ALL", _FLOORS)
def _(b, v):
    before = sh.shell_floors(b, STEP)
    after = sh.shell_floors(sh.flatten(b, sh.fit_pedestal(before, 0.5, 3.0), 3.0), STEP)
    j = before.filter("floor is not null").select("volume_id", "shell", F.round("floor", 4).alias("floor_before"))
    return j.join(after.select("volume_id", "shell", "n_measured", F.round("floor", 4).alias("floor_after")), ["volume_id", "shell"])


@query("agg_consistency", " SELECT ROUND(CORR(x, y), 6) AS r, ROUND(SQRT(AVG((x - y)**2)), 6) AS rms, ROUND(SQRT(AVG((x - y)**2)) / SQRT(AVG(x**2)), 6) AS nrms, COUNT(*) AS n FROM (" + _AN + ") WHERE mx AND my")
def _(b, v):
    a, n = (b.filter(F.col("volume_id") == x).withColumn("volume_id", F.lit("x")) for x in "AN")
    return r6(sh.consistency(a, n).drop("volume_id"), "r", "rms", "nrms")


@query("agg_even_part", """, p AS (SELECT a.volume_id, a.intensity AS x, (a.intensity + m.intensity) / 2 AS e FROM bins a JOIN bins m ON m.volume_id = a.volume_id AND m.ih = 20 - a.ih AND m.ik = 20 - a.ik AND m.il = 10 - a.il WHERE a.measured AND m.measured)
    SELECT volume_id, ROUND(CORR(x, e), 6) AS r, ROUND(SUM((x - e)**2) / SUM((x - mx)**2), 6) AS odd_share FROM p JOIN (SELECT volume_id, AVG(x) AS mx FROM p GROUP BY 1) USING (volume_id) GROUP BY 1""")
def _(b, v):
    p = lat.mirror_pairs(b, v).withColumn("e", (F.col("x") + F.col("y")) / 2)
    return r6(p.groupBy("volume_id").agg(F.corr("x", "e").alias("r"), (F.sum((F.col("x") - F.col("e")) ** 2) / (F.var_pop("x") * F.count("*"))).alias("odd_share")), "r", "odd_share")


# --- windows over profiles --------------------------------------------------------------------------------

_PROF = _SH + ", pr AS (SELECT volume_id, shell, CASE WHEN COUNT(*) >= 3 THEN quantile_cont(intensity, 0.5) END AS value FROM s WHERE measured GROUP BY ALL)"


@query("win_rolling_median", """, e AS (SELECT volume_id, MIN(shell) AS lo, MAX(shell) AS hi FROM pr GROUP BY 1),
    n AS (SELECT volume_id, shell, LEAST(GREATEST(shell + d, lo), hi) AS s FROM pr JOIN e USING (volume_id), (SELECT UNNEST([-2, -1, 0, 1, 2]) AS d))
    SELECT n.volume_id, n.shell, quantile_cont(p.value, 0.5) AS baseline FROM n LEFT JOIN pr p ON p.volume_id = n.volume_id AND p.shell = n.s GROUP BY ALL""", _PROF)
def _(b, v):
    return sh.rolling_median(sh.radial_profile(b, STEP, "median").drop("n"), 2).select("volume_id", "shell", "baseline")


@query("win_runs", """, f AS (SELECT *, CASE WHEN shell - LAG(shell) OVER (PARTITION BY volume_id ORDER BY shell) > 2 THEN 1 ELSE 0 END AS n FROM pr WHERE value % 2 = 0),
    g AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY volume_id ORDER BY shell) AS BIGINT) AS run FROM f) SELECT volume_id, run, MIN(shell) AS first, MAX(shell) AS last, MAX(value) AS peak FROM g GROUP BY ALL""", _PROF)
def _(b, v):
    return sh.runs(sh.radial_profile(b, STEP, "median"), "value % 2 = 0")


@query("win_filled", """, h AS (SELECT volume_id, shell, CASE WHEN shell % 3 <> 1 THEN value END AS value FROM pr)
    SELECT h.volume_id, h.shell, ROUND(COALESCE(h.value, CASE WHEN a.v IS NULL THEN z.v WHEN z.v IS NULL THEN a.v ELSE a.v + (z.v - a.v) * (h.shell - a.s) / (z.s - a.s) END), 6) AS filled FROM h
    LEFT JOIN LATERAL (SELECT value AS v, shell AS s FROM h x WHERE x.volume_id = h.volume_id AND x.shell <= h.shell AND x.value IS NOT NULL ORDER BY x.shell DESC LIMIT 1) a ON TRUE
    LEFT JOIN LATERAL (SELECT value AS v, shell AS s FROM h x WHERE x.volume_id = h.volume_id AND x.shell >= h.shell AND x.value IS NOT NULL ORDER BY x.shell LIMIT 1) z ON TRUE""", _PROF)
def _(b, v):
    p = sh.radial_profile(b, STEP, "median").withColumn("value", F.when(F.col("shell") % 3 != 1, F.col("value")))
    return r6(sh.filled(p).select("volume_id", "shell", "filled"), "filled")


@query("win_smoothed", """, n AS (SELECT volume_id, shell + d AS shell, value, EXP(-0.5 * (d / 1.5e0)**2) AS w FROM pr, (SELECT UNNEST([-3, -2, -1, 0, 1, 2, 3]) AS d) WHERE value IS NOT NULL)
    SELECT pr.volume_id, pr.shell, ROUND(SUM(w * n.value) / SUM(w), 6) AS smooth FROM pr LEFT JOIN n USING (volume_id, shell) GROUP BY ALL""", _PROF)
def _(b, v):
    return r6(sh.smoothed(sh.radial_profile(b, STEP, "median").drop("n"), 1.5, 3).select("volume_id", "shell", "smooth"), "smooth")


@query("win_snip")
def _(b, v):
    return r6(sh.snip(sh.radial_profile(b, STEP, "median").filter("value is not null"), 3), "baseline")


@query("dom_ring_shells", """, e AS (SELECT volume_id, MIN(shell) AS lo, MAX(shell) AS hi FROM pr GROUP BY 1),
    n AS (SELECT volume_id, shell, LEAST(GREATEST(shell + d, lo), hi) AS s FROM pr JOIN e USING (volume_id), (SELECT UNNEST([-2, -1, 0, 1, 2]) AS d)),
    bl AS (SELECT n.volume_id, n.shell, quantile_cont(p.value, 0.5) AS base FROM n LEFT JOIN pr p ON p.volume_id = n.volume_id AND p.shell = n.s GROUP BY ALL),
    x AS (SELECT volume_id, shell, value - base AS value FROM pr JOIN bl USING (volume_id, shell)), f AS (SELECT *, CASE WHEN shell - LAG(shell) OVER (PARTITION BY volume_id ORDER BY shell) > 2 THEN 1 ELSE 0 END AS n FROM x WHERE value > 0),
    g AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY volume_id ORDER BY shell) AS BIGINT) AS run FROM f) SELECT volume_id, run, MIN(shell) AS first, MAX(shell) AS last, MAX(value) AS peak FROM g GROUP BY ALL""", _PROF)
def _(b, v):
    p = sh.rolling_median(sh.radial_profile(b, STEP, "median").drop("n"), 2)
    return sh.runs(p.select("volume_id", "shell", (F.col("value") - F.col("baseline")).alias("value")), "value > 0")


_EXT = " nb AS (SELECT a.volume_id, a.ih, a.ik, a.il, a.intensity, MAX(o.intensity) AS top FROM bins a LEFT JOIN bins o ON o.volume_id = a.volume_id AND ABS(o.ih - a.ih) <= 1 AND ABS(o.ik - a.ik) <= 1 AND ABS(o.il - a.il) <= 1 AND NOT (o.ih = a.ih AND o.ik = a.ik AND o.il = a.il) AND o.measured WHERE a.measured GROUP BY ALL)"


@query("win_local_maxima", f" SELECT {VALS}, intensity AS value FROM nb WHERE top IS NULL OR intensity >= top", _EXT)
def _(b, v):
    return lat.local_extrema(b)


@query("dom_search_peaks", f" SELECT {VALS}, intensity AS value FROM nb JOIN (SELECT volume_id AS v2, ih AS h2, ik AS k2, il AS l2, shell FROM s) ON v2 = volume_id AND h2 = ih AND k2 = ik AND l2 = il JOIN st USING (volume_id, shell) WHERE (top IS NULL OR intensity >= top) AND median IS NOT NULL AND intensity > GREATEST(27.0, median + 2 * scale)", _EXT + "," + _STATS)
def _(b, v):
    t = sh.shell_thresholds(sh.shell_stats(b, STEP), 2.0, 27.0).filter("median is not null").select("volume_id", "shell", "threshold")
    x = lat.local_extrema(b).join(b.select(*KEY, sh.shell(F.col("q"), 0.0, STEP).alias("shell")), KEY)
    return x.join(t, ["volume_id", "shell"]).filter("value > threshold").select(*KEY, "value")


@query("srt_top_features", f" SELECT * FROM (SELECT {VALS}, intensity, CAST(ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY intensity DESC, ih, ik, il) AS INT) AS rank FROM bins WHERE measured) WHERE rank <= 10")
def _(b, v):
    return lat.top_k(b.filter("measured").select(*KEY, "intensity"), "intensity", 10, ["ih", "ik", "il"])


@query("srt_dominant_axis", " SELECT volume_id, axis FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY s DESC, axis) AS r FROM (SELECT volume_id, UNNEST(['h', 'k', 'l']) AS axis, UNNEST([SUM(intensity * ABS(ih - 10)), SUM(intensity * ABS(ik - 10)), SUM(intensity * ABS(il - 5))]) AS s FROM bins GROUP BY 1)) WHERE r = 1")
def _(b, v):
    sums = [F.sum(F.col("intensity") * F.abs(F.col(f"i{a}") - m)).alias(a) for a, m in (("h", 10), ("k", 10), ("l", 5))]
    g = b.groupBy("volume_id").agg(*sums).selectExpr("volume_id", "stack(3, 'h', h, 'k', k, 'l', l) as (axis, s)")
    return flt.first_of(g, ["volume_id"], [F.col("s").desc(), F.col("axis")]).select("volume_id", "axis")


# --- regions, symmetry, fills -----------------------------------------------------------------------------


@query("dom_edge_trim", f""", g AS (SELECT volume_id, a.range AS ih, b.range AS ik, c.range AS il FROM (SELECT DISTINCT volume_id FROM bins), range(21) a, range(21) b, range(11) c),
    u AS (SELECT g.* FROM g ANTI JOIN (SELECT * FROM bins WHERE measured) USING (volume_id, ih, ik, il)),
    e AS (SELECT DISTINCT volume_id, ih + a AS ih, ik + b AS ik, il + c AS il FROM u, range(-1, 2) t1(a), range(-1, 2) t2(b), range(-1, 2) t3(c))
    SELECT {VALS}, measured AND e.volume_id IS NULL AS measured FROM bins LEFT JOIN e USING (volume_id, ih, ik, il)""".replace("e.volume_id IS NULL", "NOT COALESCE(hit, FALSE)").replace("SELECT DISTINCT volume_id, ih + a", "SELECT DISTINCT TRUE AS hit, volume_id, ih + a"))
def _(b, v):
    v = v.join(b.select("volume_id").distinct(), "volume_id")
    return lat.trim_edge(b, v).select(*KEY, "measured")


@query("dom_symmetry_average", """, im AS (SELECT volume_id, 10 + a * (ih - 10) AS ih, 10 + b * (ik - 10) AS ik, 5 + c * (il - 5) AS il, intensity, sigma FROM bins, (SELECT UNNEST([1, -1]) AS a), (SELECT UNNEST([1, -1]) AS b), (SELECT UNNEST([1, -1]) AS c) WHERE measured)
    SELECT volume_id, CAST(ih AS INT) AS ih, CAST(ik AS INT) AS ik, CAST(il AS INT) AS il, ROUND(AVG(intensity), 6) AS mean, COUNT(*) AS n, ROUND(SQRT(SUM(sigma**2)) / COUNT(*), 6) AS sigma FROM im GROUP BY ALL""")
def _(b, v):
    return r6(lat.orbit_average(b, v, lat.MMM), "mean", "sigma")


@query("agg_r_int", """, o AS (SELECT volume_id, ABS(ih - 10) AS a, ABS(ik - 10) AS b, ABS(il - 5) AS c, intensity AS x FROM bins WHERE measured), g AS (SELECT volume_id, a, b, c, AVG(x) AS m, COUNT(*) AS n FROM o GROUP BY ALL HAVING COUNT(*) >= 2)
    SELECT volume_id, ROUND(SUM(ABS(x - m)) / SUM(ABS(x)), 6) AS r_int, COUNT(*) AS n FROM o JOIN g USING (volume_id, a, b, c) GROUP BY 1""")
def _(b, v):
    return r6(lat.r_int(b, v, lat.MMM), "r_int")


@query("dom_laue_table", """, o AS (SELECT volume_id, 'mmm' AS class, ABS(ih - 10) AS a, ABS(ik - 10) AS b, ABS(il - 5) AS c, intensity AS x FROM bins WHERE measured
      UNION ALL SELECT volume_id, '4/mmm', LEAST(ABS(ih - 10), ABS(ik - 10)), GREATEST(ABS(ih - 10), ABS(ik - 10)), ABS(il - 5), intensity FROM bins WHERE measured),
    g AS (SELECT class, volume_id, a, b, c, AVG(x) AS m, COUNT(*) AS n FROM o GROUP BY ALL HAVING COUNT(*) >= 2)
    SELECT volume_id, class, ROUND(SUM(ABS(x - m)) / SUM(ABS(x)), 6) AS r_int, COUNT(*) AS n FROM o JOIN g USING (class, volume_id, a, b, c) GROUP BY ALL""")
def _(b, v):
    t = [lat.r_int(b, v, ops).withColumn("class", F.lit(name)) for name, ops in (("mmm", lat.MMM), ("4/mmm", lat.FOUR_MMM))]
    return r6(t[0].unionByName(t[1]), "r_int")


@query("dom_asymmetry", """, i AS (SELECT a.volume_id, a.intensity AS x, m.intensity AS y FROM bins a JOIN bins m ON m.volume_id = a.volume_id AND m.ih = a.ik AND m.ik = a.ih AND m.il = a.il WHERE a.measured AND m.measured)
    SELECT volume_id, ROUND(SQRT(AVG((x - y)**2)), 6) AS rms, ROUND(SQRT(AVG((x - y)**2)) / SQRT(AVG(x**2)), 6) AS relative FROM i GROUP BY 1""")
def _(b, v):
    i = lat.images(b.filter("measured").select(*KEY, F.col("intensity").alias("y")), v, ((0, 1, 0, 1, 0, 0, 0, 0, 1),))
    i = i.select("volume_id", F.col("gh").alias("ih"), F.col("gk").alias("ik"), F.col("gl").alias("il"), "y")
    j = b.filter("measured").join(i, KEY)
    d = F.sqrt(F.avg((F.col("intensity") - F.col("y")) ** 2))
    return r6(j.groupBy("volume_id").agg(d.alias("rms"), (d / F.sqrt(F.avg(F.col("intensity") ** 2))).alias("relative")), "rms", "relative")


@query("dom_components")
def _(b, v):
    return lat.region_census(lat.components(_holes(b)))


@query("set_enclosed")
def _(b, v):
    return lat.enclosed(b, v).groupBy("volume_id", "open").agg(F.count("*").alias("n"), F.countDistinct("region").alias("regions"))


@query("dom_local_fill")
def _(b, v):
    return r6(lat.local_fill(b, lat.components(_holes(b), faces=False)), "fill", "sigma")


@query("dom_shell_fill", f" SELECT {VALS}, st.median AS fill FROM hol JOIN (SELECT {VALS}, shell FROM s) x USING (volume_id, ih, ik, il) JOIN st USING (volume_id, shell)", _PUNCH + "," + _STATS)
def _(b, v):
    s = sh.shell_stats(b, STEP).select("volume_id", "shell", F.col("median").alias("fill"))
    return _holes(b).withColumn("shell", sh.shell(F.col("q"), 0.0, STEP)).join(s, ["volume_id", "shell"]).select(*KEY, "fill")


@query("dom_direct_beam_fill", " SELECT volume_id, quantile_cont(intensity, 0.5) AS fill, COUNT(*) AS n FROM qbins WHERE measured AND q > 0.45 AND q <= 0.75 GROUP BY 1")
def _(b, v):
    return b.filter("measured and q > 0.45 and q <= 0.75").groupBy("volume_id").agg(F.expr("percentile(intensity, 0.5)").alias("fill"), F.count("*").alias("n"))


@query("dom_octant_floors", """, o AS (SELECT *, CAST((h >= 0) AS INT) * 4 + CAST((k >= 0) AS INT) * 2 + CAST((l >= 0) AS INT) AS octant FROM s WHERE measured),
    f AS (SELECT volume_id, shell, octant, quantile_cont(intensity, 0.25) AS f FROM o GROUP BY ALL) SELECT volume_id, shell, ROUND(MAX(f) - MIN(f), 6) AS spread, COUNT(*) AS octants FROM f GROUP BY ALL""", _SH)
def _(b, v):
    o = sum(((F.col(a) >= 0).cast("int") * m for a, m in (("h", 4), ("k", 2), ("l", 1))), F.lit(0))
    f = b.filter("measured").groupBy("volume_id", sh.shell(F.col("q"), 0.0, STEP).alias("shell"), o.alias("octant")).agg(F.expr("percentile(intensity, 0.25)").alias("f"))
    return r6(f.groupBy("volume_id", "shell").agg((F.max("f") - F.min("f")).alias("spread"), F.count("*").alias("octants")), "spread")


@query("dom_pedestal_left", """, r AS (SELECT volume_id, RANK() OVER (PARTITION BY volume_id ORDER BY shell) AS a, RANK() OVER (PARTITION BY volume_id ORDER BY floor) AS b, floor, median FROM flo WHERE floor IS NOT NULL)
    SELECT volume_id, ROUND(CORR(a, b), 6) AS trend, ROUND((MAX(floor) - MIN(floor)) / AVG(median), 6) AS span FROM r GROUP BY 1""", _FLOORS)
def _(b, v):
    w = Window.partitionBy("volume_id")
    f = sh.shell_floors(b, STEP).filter("floor is not null").withColumn("a", F.rank().over(w.orderBy("shell"))).withColumn("b", F.rank().over(w.orderBy("floor")))
    return r6(f.groupBy("volume_id").agg(F.corr("a", "b").alias("trend"), ((F.max("floor") - F.min("floor")) / F.avg("median")).alias("span")), "trend", "span")


@query("dom_section_symmetry", """, i AS (SELECT a.volume_id, a.intensity AS x, m.intensity AS y FROM bins a JOIN bins m ON m.volume_id = a.volume_id AND m.ih = 20 - a.ih AND m.ik = 20 - a.ik AND m.il = a.il WHERE a.measured AND m.measured AND a.il = 5)
    SELECT volume_id, ROUND(SQRT(AVG((x - y)**2)) / SQRT(AVG(x**2)), 6) AS ratio FROM i GROUP BY 1""")
def _(b, v):
    s = flt.section(b, "hk0", 0.0).filter("measured")
    i = lat.images(s.select(*KEY, F.col("intensity").alias("y")), v, ((-1, 0, 0, 0, -1, 0, 0, 0, 1),))
    j = s.join(i.select("volume_id", F.col("gh").alias("ih"), F.col("gk").alias("ik"), F.col("gl").alias("il"), "y"), KEY)
    return r6(j.groupBy("volume_id").agg((F.sqrt(F.avg((F.col("intensity") - F.col("y")) ** 2)) / F.sqrt(F.avg(F.col("intensity") ** 2))).alias("ratio")), "ratio")


# --- scalars ----------------------------------------------------------------------------------------------


@query("sca_direction_cell", f" SELECT {VALS}, CAST(FLOOR(GREATEST(LEAST(1.2e0*l / q, 0.999999), -1) * 4 + 4) AS INT) AS cos_cell FROM qbins WHERE q > 0.1")
def _(b, v):
    return b.filter("q > 0.1").select(*KEY, F.floor(F.greatest(F.least(1.2 * F.col("l") / F.col("q"), F.lit(0.999999)), F.lit(-1)) * 4 + 4).cast("int").alias("cos_cell"))


@query("sca_line_shapes", " SELECT volume_id, ih, ROUND(SUM(intensity * EXP(-0.5 * ((q - 1.0) / 0.1e0)**2)), 4) AS gaussian, ROUND(SUM(intensity / (1 + ((q - 1.0) / 0.1e0)**2)), 4) AS lorentzian FROM qbins GROUP BY ALL")
def _(b, v):
    q, one, w = F.col("q"), F.lit(1.0), F.lit(0.1)
    g = b.groupBy("volume_id", "ih").agg(F.sum(F.col("intensity") * geo.gaussian(q, one, w)).alias("gaussian"), F.sum(F.col("intensity") * geo.lorentzian(q, one, w)).alias("lorentzian"))
    return g.select("volume_id", "ih", F.round("gaussian", 4).alias("gaussian"), F.round("lorentzian", 4).alias("lorentzian"))


@query("sca_d_spacing", f" SELECT {VALS}, ROUND(2 * 3.141592653589793 / q, 6) AS d FROM qbins WHERE q > 0")
def _(b, v):
    return r6(b.filter("q > 0").select(*KEY, (2 * 3.141592653589793 / F.col("q")).alias("d")), "d")


@query("sca_uniform_axis", " SELECT volume_id, ROUND(MAX(d) - MIN(d), 6) AS spread, MAX(ABS(d - 0.2)) < 2e-5 AS uniform FROM (SELECT volume_id, h - LAG(h) OVER (PARTITION BY volume_id ORDER BY ih) AS d FROM (SELECT DISTINCT volume_id, ih, h FROM bins)) GROUP BY 1")
def _(b, v):
    a = b.select("volume_id", "ih", "h").distinct().withColumn("d", F.col("h") - F.lag("h").over(Window.partitionBy("volume_id").orderBy("ih")))
    return r6(a.groupBy("volume_id").agg((F.max("d") - F.min("d")).alias("spread"), (F.max(F.abs(F.col("d") - 0.2)) < 2e-5).alias("uniform")), "spread")


@query("sca_origin_check", " SELECT DISTINCT volume_id, TRUE AS centred FROM bins WHERE ih = 10 AND ABS(h) < 2e-4")
def _(b, v):
    return b.filter("ih = 10").groupBy("volume_id").agg((F.max(F.abs("h")) < 2e-4).alias("centred"))


@query("sca_window_weight", """ SELECT volume_id, ih, ROUND((EXP(-0.5 * ((2.0e0 * ih / 20 - 1) / 0.4e0)**2) - EXP(-0.5 / 0.16e0)) / (1 - EXP(-0.5 / 0.16e0)), 6) AS gaussian, ROUND(0.5 * (1 + COS(3.141592653589793 * (2.0e0 * ih / 20 - 1))), 6) AS hann
    FROM (SELECT DISTINCT volume_id, ih FROM bins)""")
def _(b, v):
    return r6(b.select("volume_id", "ih").distinct().withColumn("gaussian", geo.window_weight("gaussian", F.col("ih"), F.lit(21))).withColumn("hann", geo.window_weight("hann", F.col("ih"), F.lit(21))), "gaussian", "hann")


@query("sca_voxel_size", " SELECT DISTINCT volume_id, ROUND(0.2e0 * CBRT(1.4e0 * 1.4e0 * 1.2e0), 6) AS size FROM bins")
def _(b, v):
    u, s = F.col("ub"), F.col("dh") * F.col("dk") * F.col("dl")
    det = u[0] * (u[4] * u[8] - u[5] * u[7]) - u[1] * (u[3] * u[8] - u[5] * u[6]) + u[2] * (u[3] * u[7] - u[4] * u[6])
    return r6(b.select("volume_id").distinct().join(v, "volume_id").select("volume_id", F.cbrt(det * s).alias("size")), "size")


# --- transform --------------------------------------------------------------------------------------------

_PREP = """ wt AS (SELECT volume_id, ih, ik, il, intensity, (0.5 * (1 + COS(3.141592653589793 * (2.0e0 * ih / 20 - 1)))) * (0.5 * (1 + COS(3.141592653589793 * (2.0e0 * ik / 20 - 1)))) * (0.5 * (1 + COS(3.141592653589793 * (2.0e0 * il / 10 - 1)))) AS w FROM bins WHERE measured),
 pp AS (SELECT wt.*, (intensity - m) * w AS value FROM wt JOIN (SELECT volume_id, SUM(w * intensity) / SUM(w) AS m FROM wt GROUP BY 1) USING (volume_id))"""


@query("dom_transform_prepared", f" SELECT {VALS}, ROUND(value, 5) + 0.0e0 AS value FROM pp", _PREP)
def _(b, v):
    return tr.prepared(b, v, "hann").select(*KEY, (F.round("value", 5) + F.lit(0.0)).alias("value"))


_WANT = [(10, 10, 5), (11, 10, 5), (10, 12, 5), (13, 9, 6), (3, 17, 2)]


@query("dom_delta_pdf_points", " SELECT volume_id, x AS ix, y AS iy, z AS iz, ROUND(SUM(value * COS(2 * 3.141592653589793 * ((ih - 10) * (x - 10) / 21.0e0 + (ik - 10) * (y - 10) / 21.0e0 + (il - 5) * (z - 5) / 11.0e0))), 3) AS value FROM pp, (VALUES " + ", ".join(map(str, _WANT)) + ") w(x, y, z) GROUP BY ALL", _PREP)
def _(b, v):
    s = b.sparkSession
    w = s.createDataFrame([(x, *p) for x in "ANR" for p in _WANT], "volume_id string, ix int, iy int, iz int")
    pdf = tr.delta_pdf(b, v, "hann").join(F.broadcast(w), ["volume_id", "ix", "iy", "iz"])  # 15 rows
    return pdf.select("volume_id", "ix", "iy", "iz", F.round("value", 3).alias("value"))


@query("dom_round_trip", " SELECT volume_id, COUNT(*) AS n, TRUE AS exact FROM pp WHERE w > 1e-3 GROUP BY 1", _PREP)
def _(b, v):
    r = tr.round_trip(b, v, "hann")
    return r.groupBy("volume_id").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("recon") - F.col("intensity"))) < 1e-6).alias("exact"))


@query("dom_features")
def _(b, v):
    return r6(tr.strongest(tr.delta_pdf(b, v, "hann"), 3.0), "x", "y", "z", "value", "length", "in_sigma")


@query("dom_map_sigma")
def _(b, v):
    return r6(tr.sigma_outside_origin(tr.delta_pdf(b, v, "hann")), "median", "sigma")
