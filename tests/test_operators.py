"""Planted truths and independent computations for operators that SQL can't express, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import filters as flt
from gridloom.operators import lattice as lat
from gridloom.operators import shells as sh
from gridloom.operators import transform as tr
from gridloom.plans import lineage
from gridloom.sources import bins as src

SCHEMA = "volume_id string, ih int, ik int, il int, h double, k double, l double, intensity double, sigma double, measured boolean"


def cube(spark, value, n=7, keep=lambda i, j, k: True):
    m = n // 2
    rows = [("v", i, j, k, (i - m) * 0.2, (j - m) * 0.2, (k - m) * 0.2, float(value(i, j, k)), 1.0, bool(keep(i, j, k))) for i in range(n) for j in range(n) for k in range(n)]
    b = spark.createDataFrame(rows, SCHEMA)
    return b, src.volumes_of(b, (n, n, n))


def test_transform_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 7, 7))
    b, v = cube(spark, lambda i, j, k: x[i, j, k])
    got = np.zeros((7, 7, 7), complex)
    for r in tr.fft(b.withColumn("value", F.col("intensity")), v).collect():
        got[r.ih, r.ik, r.il] = r.re + 1j * r.im
    assert np.allclose(got, np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(x))))
    back = tr.round_trip(b, v, "none")
    assert back.filter("abs(recon - intensity) > 1e-9").count() == 0 and back.count() == 343


def test_pair_correlation_peak_is_found(spark):
    # a modulation along h with period 3.5 bins gives a map feature at n / 3.5 = 2 bins
    b, v = cube(spark, lambda i, j, k: 10 + np.cos(2 * np.pi * i / 3.5))
    pdf = tr.delta_pdf(b, v, "none")
    top = pdf.orderBy(F.abs("value").desc()).head()
    assert abs(top.ix - 3) == 2 and top.iy == top.iz == 3


def test_components_find_planted_regions(spark):
    inside = lambda i, j, k: (i < 2 and j < 2 and k < 2) or (i > 4 and j > 4 and k == 3) or (i == j == 3)
    b, v = cube(spark, lambda i, j, k: 1)
    mask = b.filter(F.expr("(ih < 2 and ik < 2 and il < 2) or (ih > 4 and ik > 4 and il = 3) or (ih = 3 and ik = 3)"))
    got = sorted(r.n for r in lat.region_census(lat.components(mask)).collect())
    assert got == [4, 7, 8] and sum(got) == sum(inside(i, j, k) for i in range(7) for j in range(7) for k in range(7))
    snake = b.filter("il = 0 and (ik % 2 = 0 or (ik % 4 = 1 and ih = 6) or (ik % 4 = 3 and ih = 0))")
    assert lat.region_census(lat.components(snake)).count() == 1


def test_enclosed_space_is_told_from_open(spark):
    b, v = cube(spark, lambda i, j, k: 1, keep=lambda i, j, k: not ((i, j, k) == (3, 3, 3) or i == 0))
    got = {r.open: r.n for r in lat.enclosed(b, v).groupBy("open").count().withColumnRenamed("count", "n").collect()}
    assert got == {True: 49, False: 1}


def test_local_fill_takes_the_median_around(spark):
    b, v = cube(spark, lambda i, j, k: 5 + i)
    hole = b.filter("ih = 3 and ik = 3 and il = 3").withColumn("region", F.lit(1).cast("long"))
    r = lat.local_fill(b, hole, 1).head()
    assert r.n == 26 and r.fill == 8.0
    assert lat.local_fill(b, hole, 1, least=100).head().fill == 8.0


def test_snip_leaves_baselines_and_cuts_peaks(spark):
    line = [("v", i, 10.0 + (30.0 if i == 10 else 0.0)) for i in range(21)]
    got = {r.shell: r.baseline for r in sh.snip(spark.createDataFrame(line, "volume_id string, shell int, value double"), 3).collect()}
    assert all(abs(x - 10) < 1e-12 for x in got.values())


def test_shell_edges_land_as_the_edges_say(spark):
    step = 0.05
    edges = [k * step for k in range(200)]
    rows = [(float(x),) for e in edges for x in (e, np.nextafter(e, -1), np.nextafter(e, 9))]
    got = spark.createDataFrame(rows, "q double").select("q", sh.shell(F.col("q"), 0.0, step).alias("b")).collect()
    assert all(r.b * step <= r.q < (r.b + 1) * step for r in got)


def test_ranked_floors_equal_percentiles(spark):
    rng = np.random.default_rng(2)
    b, v = cube(spark, lambda i, j, k: rng.integers(0, 30))
    q = src.with_q(b, v)
    a = {r.shell: r.floor for r in sh.shell_floors(q, 0.4, least=1).collect()}
    z = {r.shell: r.floor for r in sh.ranked_floors(q, 0.4, cuts=5).collect()}
    assert a.keys() == z.keys() and all(abs(a[k] - z[k]) < 1e-9 for k in a)


def test_save_and_read(spark, tmp_path):
    b, v = cube(spark, lambda i, j, k: i + j + k, 3)
    src.save(b, v, str(tmp_path))
    rb, rv = src.read(spark, str(tmp_path))
    assert sorted(map(tuple, rb.collect())) == sorted(map(tuple, b.collect())) and rv.count() == 1


def test_from_arrays_and_sections(spark):
    df = spark.createDataFrame([("v", [[[1.0, 2.0], [3.0, None]], [[4.0, 5.0], [6.0, 7.0]]], 0.0, 1.0, 0.0, 1.0, -1.0, 1.0)], "volume_id string, data array<array<array<double>>>, h0 double, h1 double, k0 double, k1 double, l0 double, l1 double")
    b = src.from_arrays(df)
    assert b.count() == 8 and b.filter("not measured").count() == 1
    mid = {(r.ih, r.ik): r.value for r in flt.section_between(b, "hk0", 0.0).collect()}
    assert mid == {(0, 0): 1.5, (0, 1): 3.0, (1, 0): 4.5, (1, 1): 6.5}


def test_staleness_cascades(spark):
    rec = spark.createDataFrame([("v", "average", "a", "raw", 1), ("v", "rings", "old", "x", 1), ("v", "punch", "c", "y", 1)], "volume_id string, stage string, settings string, input_id string, made_at int")
    want = spark.createDataFrame([("v", 0, "average", "a", "raw"), ("v", 1, "rings", "b", "x"), ("v", 2, "punch", "c", "y"), ("v", 3, "flatten", "d", "z")], "volume_id string, position int, stage string, settings string, input_id string")
    got = {r.stage: r.reason for r in lineage.staleness(rec, want).collect()}
    assert got == {"average": None, "rings": "settings", "punch": "upstream", "flatten": "missing"}


def test_chain_runs_stale_stages_only(spark, tmp_path):
    b, _ = cube(spark, lambda i, j, k: 1, 3)
    ran = []

    def stage(name):
        def f(df, s):
            ran.append(name)
            return df.withColumn("intensity", F.col("intensity") * s["by"])

        return f

    chain = lambda y: [("one", {"by": 2.0}, stage("one")), ("off", {"by": 0.0, "enabled": False}, stage("off")), ("two", {"by": y}, stage("two"))]
    assert lineage.run_chain(b, chain(3.0), str(tmp_path)).head().intensity == 6.0
    assert lineage.run_chain(b, chain(5.0), str(tmp_path)).head().intensity == 10.0
    assert ran == ["one", "two", "two"]


def test_wide_neighbourhoods_are_refused(spark):
    b, _ = cube(spark, lambda i, j, k: 1, 3)
    with pytest.raises(ValueError):
        lat.offsets(b, 5)


def test_laplace_fill_is_harmonic(spark):
    from gridloom.operators import cleaning as cl

    # a linear field is harmonic: holes get it back exactly; a region without measured neighbours takes the median
    b, v = cube(spark, lambda i, j, k: 2 * i - j + 3 * k)
    holes = b.filter("ih between 2 and 4 and ik between 2 and 4 and il between 2 and 4").withColumn("region", F.lit(7).cast("long"))
    got = cl.laplace_fill(b, holes.select("volume_id", "ih", "ik", "il", "region")).collect()
    assert len(got) == 27 and all(abs(r.fill - (2 * r.ih - r.ik + 3 * r.il)) < 1e-8 for r in got)
    plain = cl.laplace_fill(b, holes.select("volume_id", "ih", "ik", "il", "region"), most=5).collect()
    assert len(plain) == 27 and len({r.fill for r in plain}) == 1


def test_pooled_rings_take_off_a_planted_ring(spark):
    from gridloom.operators import cleaning as cl

    b, v = cube(spark, lambda i, j, k: 10 + (40 if 2.0 < np.hypot(j - 5, k - 5) <= 3.0 else 0), 11)  # what the shell holds
    q = b.withColumn("q", F.sqrt(F.col("k") ** 2 + F.col("l") ** 2))
    shells = spark.createDataFrame([("v", 2)], "volume_id string, shell int")
    out = cl.remove_rings(q, "h", shells, 0.2000001, sectors=4)
    on = out.filter("removed > 0")
    assert on.count() > 0 and on.filter("abs(intensity - 10) > 1e-9 and removed < 40").count() == 0
    none = cl.remove_rings(q, "h", shells.limit(0), 0.2000001, sectors=4)
    assert none.filter("removed <> 0").count() == 0


def test_weighted_median(spark):
    from gridloom.operators import cleaning as cl

    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 5.0), ("b", 4.0, 2.0)], "g string, v double, w double")
    assert {r.g: r.median for r in cl.weighted_median(df, ["g"], "v", "w").collect()} == {"a": 9.0, "b": 4.0}


def test_a_large_side_without_a_key_is_refused(spark):
    from gridloom.functions.sizes import bounded

    assert bounded(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        bounded(spark.range(4), 3)
