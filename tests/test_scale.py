"""How the work of a query is laid out: nothing broadcast by mistake, no row multiplied before it is shuffled, one fold."""

import numpy as np
import pytest

from gridloom.operators import cells as ce
from gridloom.operators import cleaning as cl
from gridloom.operators import lattice as lat
from gridloom.operators import peaks as pk
from gridloom.operators import resample as rs
from gridloom.operators import rings as rg
from gridloom.plans import registry
from gridloom.sources import bins as src

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_powder_lines_of_many_structures_carry_over_batches(spark):
    rng = np.random.default_rng(3)
    atoms = [(int(s), *map(float, rng.random(3)), float(w)) for s, w in zip(np.repeat(range(7), [1, 2, 9, 1, 30, 4, 5]), rng.integers(-2, 4, 52), strict=True)]
    a = spark.createDataFrame(atoms, "structure int, x double, y double, z double, weight double")
    r = spark.createDataFrame([(h, k, 1, float(np.sqrt(h * h + k * k + 1))) for h in range(3) for k in range(3)], "h int, k int, l int, q double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {tuple(x)[:4]: (x.f2, x.intensity) for x in rg.powder_lines(r, a, 8.0, "structure").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = {tuple(x)[:4]: (x.f2, x.intensity) for x in rg.powder_lines(r.crossJoin(a.select("structure").distinct()), a, 8.0, "structure").select("structure", "h", "k", "l", "f2", "intensity").collect()}
    want = {}
    for s in range(7):
        x, w = np.array([t[1:4] for t in atoms if t[0] == s]), np.array([t[4] for t in atoms if t[0] == s])
        for h, k, l, q in map(tuple, r.collect()):
            f2 = abs((w * np.exp(2j * np.pi * (x @ (h, k, l)))).sum()) ** 2
            if f2 > 1e-8 * np.abs(w).sum() ** 2:
                want[s, h, k, l] = (f2, f2 / (64 * q * q))
    assert got.keys() == want.keys() == own.keys()
    assert all(np.allclose(got[i], want[i]) and np.allclose(own[i], want[i]) for i in want)


def test_powder_lines_with_null_coordinates(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0), (1, None, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 0.0, 1.0), (2, None, None, None, None)], "structure int, x double, y double, z double, weight double")
    r = spark.createDataFrame([(1, 0, 0, 1.0)], "h int, k int, l int, q double")
    assert [tuple(x) for x in rg.powder_lines(r, a, 1.0, "structure").collect()] == [(1, 1, 0, 0, 1.0, 4.0, 4.0)]


def test_powder_lines_are_not_broadcast(spark):
    assert "Broadcast" not in plan(registry.queries()["dom_powder_lines"](spark, SF))


@pytest.mark.parametrize("name", ["dom_laue_candidates", "sca_metric_change", "dom_cell_permutation", "dom_modulation_positions"])
def test_rows_are_judged_in_place(spark, name):
    assert "Exchange" not in plan(registry.queries()[name](spark, SF)) and "Aggregate" not in plan(registry.queries()[name](spark, SF))


def test_laue_candidates_as_matrices(spark):
    rng = np.random.default_rng(11)
    ubs = [np.diag([1.4, 1.4, 1.2]), np.diag([1.0, 1.0, 1.0]), rng.normal(size=(3, 3)), np.array([[1.0, 0.5, 0.0], [0.0, 0.75**0.5, 0.0], [0.0, 0.0, 0.9]])]
    grids = [(-2.0, -2.0, -1.0, 0.2, 0.2, 0.2), (-1.9, -2.0, -1.0, 0.2, 0.25, 0.2), (-2.0, -2.0, -2.0, 0.2, 0.2, 0.2), (-2.0, -2.0, -1.0, 0.2, 0.4, 0.1)]
    rows = [(f"{i}{j}", u.ravel().tolist(), *g) for i, u in enumerate(ubs) for j, g in enumerate(grids)]
    v = spark.createDataFrame(rows, "volume_id string, ub array<double>, h0 double, k0 double, l0 double, dh double, dk double, dl double")
    got = {(r.volume_id, r.laue): r for r in ce.laue_candidates(v).collect()}
    assert len(got) == 16 * 13
    for name, u, *g in rows:
        metric, start, step = np.array(u).reshape(3, 3).T @ np.array(u).reshape(3, 3), np.array(g[:3]), np.array(g[3:])
        for laue in ce.LAUE_CLASSES:
            ops = [np.array(m, float).reshape(3, 3) for m in ce.laue_operations(laue)]
            change = max(np.abs(m.T @ metric @ m - metric).max() for m in ops) / np.abs(metric).max()
            off = [x for m in ops for x in (m * step[None, :] / step[:, None]).ravel()] + [x for m in ops for x in (m - np.eye(3)) @ start / step]
            off = max(abs(x - round(x)) for x in off)
            r = got[name, laue]
            assert r.operations == len(ops) and abs(r.change - change) < 1e-9
            assert r.reason == ("metric" if change > 0.02 else "grid" if off > 1e-3 else None) and r.allowed == (r.reason is None)


def test_positions_of_several_vectors(spark):
    w = spark.createDataFrame([("a", 2500, 0, 0), ("a", 5000, 0, 0), ("b", 0, 0, 0)], "volume_id string, h int, k int, l int")
    got = sorted(map(tuple, cl.positions_of(w, lat.MMM, 2).collect()))
    assert got == [("a", 0, 0, 0, 2), ("a", 2500, 0, 0, 1), ("a", 5000, 0, 0, 1), ("a", 7500, 0, 0, 1), ("b", 0, 0, 0, 1)]
    one = sorted(map(tuple, cl.positions_of(w.filter("h <> 5000"), lat.MMM, 2, single=True).collect()))
    assert one == [("a", 2500, 0, 0, 1), ("a", 5000, 0, 0, 2), ("a", 7500, 0, 0, 1), ("b", 0, 0, 0, 1)]


def test_permutation_fit_on_ties_and_nulls(spark):
    c = spark.createDataFrame([("tie", 4.0, 4.0, 6.0), ("none", None, None, None)], "volume_id string, a double, b double, c double")
    got = {r.volume_id: (r.perm, r.misfit) for r in rs.permutation_fit(c, (4.0, 5.0, 6.0)).collect()}
    assert got == {"tie": ("abc", 0.25), "none": ("abc", None)}


@pytest.mark.parametrize("name", ["dom_ring_models", "agg_undersampled", "flt_capsule", "win_pooled_profiles", "dom_search_peaks", "dom_shell_fill"])
def test_lineitem_is_folded_once(spark, name):
    assert "parquet" not in plan(registry.queries()[name](spark, SF))


def test_node_centres_are_those_of_peaks_and_moments(spark):
    b = src.scans(spark, SF)
    p = pk.numbered(lat.node_peaks(lat.nodes(b)))
    want = {tuple(r)[:7]: tuple(r)[7:] for r in p.join(pk.moments(p, b), ["volume_id", "peak_id"]).select("volume_id", "nh", "nk", "nl", "ih", "ik", "il", "ch", "ck", "cl").collect()}
    c = pk.node_centres(b, 0.2)
    got = {tuple(r)[:7]: tuple(r)[7:] for r in c.collect()}
    assert len(want) > 100 and got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)
    with pytest.raises(ValueError):
        pk.node_centres(b, 0.2, radius=2)


@pytest.mark.parametrize("name", ["dom_radial_offsets", "dom_ub_fit"])
def test_centres_read_their_bins_once(spark, name):
    p = plan(registry.queries()[name](spark, SF))
    assert sum("FileScan" in x for x in p.splitlines()) == 1 and "Join" not in p


def test_rounds_without_outliers_share_one_shuffle(spark):
    p = plan(registry.queries()["dom_rotation_diagnosis"](spark, SF))
    assert sum("Exchange" in x for x in p.splitlines()) == 1 and "Join" not in p
    assert sum("FileScan" in x for x in p.splitlines()) == 1 and "ExistingRDD" not in p  # nothing ran before


def test_scans_dealt_out_by_volume_are_the_same(spark):
    dealt = src.scans(spark, SF, together=True)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, src.scans(spark, SF).collect()))
    assert sum("Exchange" in x for x in plan(dealt.groupBy("volume_id").count()).splitlines()) == 1
