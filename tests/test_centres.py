"""Measured centres and the refined orientation against planted sub-bin shifts and turns."""

import numpy as np
from planted import frames, gaussians

from gridloom.operators import centres as ct

UB = np.array([[1.4, 0.1, 0.0], [0.0, 1.5, 0.05], [0.0, 0.0, 1.2]])
STEP, SHAPE = 0.06, (61, 61, 61)
NODES = [(h, k, l) for h in (-1, 0, 1) for k in (-1, 0, 1) for l in (-1, 0, 1) if (h, k, l) != (0, 0, 0)]


def turn(axis, degrees):
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    t = np.radians(degrees)
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def volume(spark, peaks, noise=0.3, name="v", seed=0):
    data = gaussians(SHAPE, STEP, UB, [(p, np.eye(3) * 0.07**2, 400.0) for p in peaks], noise=noise, seed=seed)
    return frames(spark, data, STEP, UB, name=name)


def test_planted_shifts_come_back(spark):
    r = np.random.default_rng(3)
    where = {n: np.array(n) + r.uniform(-0.4, 0.4, 3) * STEP for n in NODES}
    bins, vols = volume(spark, where.values())
    rows = ct.measured_centres(bins, vols, reach=0.25).collect()
    got = {(x.nh, x.nk, x.nl): x for x in rows if x.status == "centred"}
    assert set(got) == set(NODES) and len(rows) == len({(x.nh, x.nk, x.nl) for x in rows})
    for n, x in got.items():
        assert np.abs(np.array([x.ch, x.ck, x.cl]) - where[n]).max() < 0.02 * STEP and x.significance > 100


def test_missing_weak_and_other_cells(spark):
    bins, vols = volume(spark, [n for n in NODES if n != (1, 1, 1)])
    bins = bins.filter("not (abs(h + 1) < 0.3 and abs(k + 1) < 0.3 and abs(l) < 0.3)")
    got = {(x.nh, x.nk, x.nl): x.status for x in ct.measured_centres(bins, vols, reach=0.2).collect()}
    assert got[1, 1, 1] == "weak" and got.get((-1, -1, 0)) in (None, "no_bins") and got[1, 0, 0] == "centred"
    assert ct.measured_centres(bins, vols, cell=(2, 2, 2)).count() == 0  # ±2 is off this grid
    near = ct.measured_centres(bins, vols, reach=0.2, q_max=1.3).collect()
    assert {(x.nh, x.nk, x.nl) for x in near} == {(0, 0, 1), (0, 0, -1)}
    assert ct.measured_centres(bins.limit(0), vols).count() == 0


def test_window_against_plain_iteration():
    r = np.random.default_rng(5)
    q = r.uniform(-0.5, 0.5, (4000, 3))
    e = np.exp(-0.5 * ((q - 0.05) ** 2).sum(1) / 0.1**2)
    at = ct.windowed_centre(q, e, np.zeros(3), 0.1, 0.3)
    d = q - at
    w = e * np.exp(-(d**2).sum(1) / 0.02) * ((d**2).sum(1) <= 0.09)
    assert np.abs(w @ d / w.sum()).max() < 1e-6 and np.abs(at - 0.05).max() < 0.02
    assert ct.windowed_centre(q, -e, np.zeros(3), 0.1, 0.3) is None and ct.windowed_centre(q, e, np.zeros(3) - 0.3, 0.1, 0.05) is None


def test_refined_orientation_in_passes(spark):
    """A turn of 7.5° is found from low |Q| outward, and a crystal that sits right is left alone."""
    true = turn((1, 2, 3), 7.5) @ UB
    at = [np.linalg.inv(UB) @ true @ np.array(n) for n in NODES]
    bins, vols = volume(spark, at)
    bins2, vols2 = volume(spark, NODES, name="w", seed=1)
    b, v = bins.unionByName(bins2).cache(), vols.unionByName(vols2)
    centres, fit = ct.refined_orientation(b, v, "orientation", passes=2, q_max=3.0, reach=0.2)
    got = {r.volume_id: r for r in fit.collect()}
    assert np.abs(np.array(got["v"].fitted).reshape(3, 3) - true).max() < 2e-3 and abs(got["v"].angle - 7.5) < 0.05
    assert got["w"].angle < 0.02 and got["v"]["pass"] == 2
    assert centres.filter("volume_id = 'v' and status = 'centred'").count() == len(NODES)
