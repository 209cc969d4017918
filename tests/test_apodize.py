"""Invariant ellipsoids and the window that keeps off open space."""

import numpy as np
import pytest
from planted import frames

from gridloom.operators import apodize as ap
from gridloom.operators import transform as tr

HEX = 1.5 * np.array([[1, 0.5, 0], [0, np.sqrt(3) / 2, 0], [0, 0, 0.8]])
CUBIC = np.eye(3) * 1.4


def one(spark, ub, shape=(21, 21, 15), step=0.2, data=None, ok=None, name="v"):
    data = np.ones(shape) if data is None else data
    return frames(spark, data, step, ub, measured=ok, name=name)


@pytest.mark.parametrize(("ub", "n"), [(CUBIC, 48), (HEX, 24), (np.diag([1, 1, 1.3]), 16), (np.diag([1, 1.2, 1.5]), 8), (np.array([[1, 0.3, 0.2], [0, 1.2, 0.1], [0, 0, 1.5]]), 2), (np.zeros((3, 3)), 2)])
def test_point_group_of_the_lattice(spark, ub, n):
    _, v = one(spark, ub, (3, 3, 3))
    r = ap.lattice_group(v).first()
    ops = np.array([list(o) for o in r.ops]).reshape(-1, 3, 3)
    assert len(ops) == n
    g = ub.T @ ub
    assert all(np.allclose(o.T @ g @ o, g, atol=0.05 * g.max() + 1e-12) for o in ops)
    assert len({(a @ b).tobytes() for a in ops for b in ops}) == n  # closed


def test_one_plane_axis_takes_no_part(spark):
    _, v = one(spark, CUBIC, (5, 5, 1))
    assert len(ap.lattice_group(v).first().ops) == 16
    f = np.array(ap.ellipsoids(v).first().form).reshape(3, 3)
    assert np.allclose(f, np.diag([1 / 0.16, 1 / 0.16, 0]))


def test_hexagonal_ellipsoid_is_invariant_and_the_largest(spark):
    _, v = one(spark, HEX)
    r = ap.ellipsoids(v).first()
    m = np.array(r.form).reshape(3, 3)
    half = np.array([2.0, 2.0, 1.4])
    want = np.array([[4 / 3, 2 / 3, 0], [2 / 3, 4 / 3, 0], [0, 0, 0]]) / 4 + np.diag([0, 0, 1 / 1.4**2])
    assert r.n_ops == 24 and np.allclose(m, want, atol=1e-9)
    assert np.all(np.diag(np.linalg.inv(m)) <= half**2 + 1e-9)
    rng = np.random.default_rng(0)
    ops = np.array([list(o) for o in ap.lattice_group(v).first().ops]).reshape(-1, 3, 3)
    for _ in range(200):  # no other invariant ellipsoid in the box is larger
        a = rng.normal(size=(3, 3))
        a = a @ a.T
        a = np.mean([o @ a @ o.T for o in ops], axis=0)
        a = a / (np.diag(a) / half**2).max()
        assert np.linalg.det(a) <= np.linalg.det(np.linalg.inv(m)) + 1e-9


def test_window_keeps_off_planted_gaps(spark):
    shape = (21, 21, 15)
    ok = np.ones(shape, bool)
    ok[:, 15:, 6:] = False  # open: it reaches the faces
    ok[9:11, 9, 7] = False  # a hole inside is no open space
    bins, v = one(spark, CUBIC, ok=ok)
    full = frames(spark, np.ones(shape), 0.2, CUBIC, name="w")
    bins, v = bins.unionByName(full[0]).cache(), v.unionByName(full[1])
    open_ = ap.open_space(bins, v).cache()
    assert open_.count() == 21 * 6 * 9
    for kind in ("gaussian", "hann"):
        w = ap.fitted_windows(bins, v, kind).cache()
        got = {r.volume_id: r for r in w.collect()}
        assert got["w"].scale == 1.0 and 0 < got["v"].scale < 1 and got["v"].open_weight <= 1e-3
        share = {r.volume_id: r.share for r in ap.weight_on(v, w, open_, kind).collect()}
        assert share["v"] <= 1.02e-3 and share["w"] == 0
        larger = w.withColumn("form", ap.F.transform("form", lambda x: x / 1.02**2))
        assert {r.volume_id: r.share for r in ap.weight_on(v, larger, open_, kind).collect()}["v"] > 1e-3
    none = ap.fitted_windows(bins, v, tolerance=0.0)
    assert max(r.share for r in ap.weight_on(v, none, open_).collect()) == 0


def test_windowed_values_go_into_the_transform(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(9, 9, 7)) + 10
    bins, v = one(spark, CUBIC, (9, 9, 7), data=data)
    w = ap.ellipsoids(v)
    p = ap.windowed(bins, v, w)
    grid = np.stack(np.meshgrid(*[(np.arange(n) - n // 2) * 0.2 for n in (9, 9, 7)], indexing="ij"), -1)
    rho = np.sqrt(np.einsum("...i,ij,...j", grid, np.array(w.first().form).reshape(3, 3), grid))
    edge = np.exp(-0.5 / 0.16)
    weight = np.where(rho < 1, (np.exp(-0.5 * (rho / 0.4) ** 2) - edge) / (1 - edge), 0)
    value = (data - (weight * data).sum() / weight.sum()) * weight
    want = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(value))).real
    for r in tr.fft(p, v).collect():
        assert abs(r.re - want[r.ih, r.ik, r.il]) < 1e-9


def test_origin_outside_has_no_window(spark):
    bins, v = one(spark, CUBIC, (5, 5, 5))
    v = v.selectExpr("volume_id", "nh", "nk", "nl", "0.5D as h0", "dh", "k0", "dk", "l0", "dl", "ub")
    r = ap.fitted_windows(bins, v).first()
    assert r.form is None and ap.windowed(bins, v, ap.fitted_windows(bins, v)).count() == 0
