"""Powder shells with an angular field: harmonics, the robust fit, and a planted anisotropic ring that goes."""

import numpy as np
import pytest
from planted import frames

from gridloom.operators import angular as an

UB, STEP, SHAPE, BIN = np.diag([1.0, 1.0, 1.1]), 0.15, (33, 33, 33), 0.05


def field(d):
    return 40 * (1 + 0.5 * (1.5 * d[..., 2] ** 2 - 0.5) + 0.3 * d[..., 0])


def ring(q, q0, fwhm):
    return 0.5 / (1 + (2 * (q - q0) / fwhm) ** 2) + 0.5 * np.exp(-4 * np.log(2) * ((q - q0) / fwhm) ** 2)


@pytest.fixture(scope="module")
def planted(spark):
    grid = np.stack(np.meshgrid(*[(np.arange(n) - n // 2) * STEP for n in SHAPE], indexing="ij"), -1) @ UB.T
    q = np.linalg.norm(grid, axis=-1)
    d = grid / np.maximum(q, 1e-9)[..., None]
    smooth = 5 + 3 * np.exp(-q)
    rings = field(d) * ring(q, 1.8, 0.12)
    data = smooth + rings + 0.3 * np.random.default_rng(1).normal(size=SHAPE)
    rng = np.random.default_rng(2)
    for _ in range(25):  # sharp peaks on the ring are outliers of their cells
        data[tuple(rng.integers(0, 33, 3))] += 500
    bins, vols = frames(spark, data, STEP, UB)
    bins = bins.selectExpr("*", f"sqrt(h*h + k*k + {UB[2, 2] ** 2}*l*l) as q").cache()
    shells = spark.createDataFrame([("v", 1, 1.8, 0.12, 40.0)], "volume_id string, ring_id int, q0 double, fwhm double, height double")
    mid = (np.arange(80) + 0.5) * BIN
    base = spark.createDataFrame([("v", i, float(5 + 3 * np.exp(-m))) for i, m in enumerate(mid)], "volume_id string, shell int, value double")
    return bins, vols, shells, base, q, rings, data


def test_harmonics_are_orthonormal():
    z, w = np.polynomial.legendre.leggauss(20)
    phi = np.arange(40) * 2 * np.pi / 40
    zz, pp = np.repeat(z, 40), np.tile(phi, 20)
    s = np.sqrt(1 - zz**2)
    y = an.harmonics(s * np.cos(pp), s * np.sin(pp), zz, 6)
    assert y.shape[1] == 49 and np.allclose((y * np.repeat(w, 40)[:, None]).T @ y * 2 * np.pi / 40, np.eye(49), atol=1e-12)
    assert np.allclose(an.harmonics(np.array([0.6]), np.array([0.0]), np.array([0.8]), 1)[0, [0, 2]], [0.5 / np.sqrt(np.pi), np.sqrt(3 / 4 / np.pi) * 0.8])


def test_planted_anisotropic_ring_goes(spark, planted):
    bins, vols, shells, base, q, rings, data = planted
    fits = an.fit_shells(bins, vols, shells, base, BIN).cache()
    f = fits.first()
    assert f.degree == 4 and f.n_cells > 100 and f.coverage > 0.4
    model = an.shell_model(bins, vols, shells, fits, base, BIN)
    out = np.zeros(SHAPE)
    for r in an.remove_shells(bins, model, "mean").select("ih", "ik", "il", "removed").collect():
        out[r.ih, r.ik, r.il] = r.removed
    on = np.abs(q - 1.8) < 0.06
    assert np.abs(out - rings)[on].sum() < 0.15 * rings[on].sum()
    # without the ridge, which draws the field towards its mean, only noise and the grid are left
    fits = an.fit_shells(bins, vols, shells, base, BIN, ridge=1e-4)
    free = np.zeros(SHAPE)
    for r in an.shell_model(bins, vols, shells, fits, base, BIN).collect():
        free[r.ih, r.ik, r.il] = r["mean"]
    assert np.abs(free - rings)[on].sum() < 0.06 * rings[on].sum()
    assert np.all(out[np.abs(q - 1.8) > 0.37] == 0)


def test_conservative_policy_takes_less_and_sigma_grows(spark, planted):
    bins, vols, shells, base, q, rings, _ = planted
    fits = an.fit_shells(bins, vols, shells, base, BIN)
    model = an.shell_model(bins, vols, shells, fits, base, BIN).cache()
    sums = {p: an.remove_shells(bins, model, p).selectExpr("sum(removed) r", "sum(sigma) s").first() for p in ("conservative", "mean", "none")}
    assert 0 < sums["conservative"].r < sums["mean"].r and sums["none"].r == 0
    assert sums["none"].s > bins.selectExpr("sum(sigma) s").first().s
    with pytest.raises(ValueError):
        an.remove_shells(bins, model, "all")


def test_few_directions_lower_the_degree(spark, planted):
    bins, vols, shells, base, *_ = planted
    slab = bins.filter("abs(l) < 0.2")
    f = an.fit_shells(slab, vols, shells, base, BIN).first()
    assert f is not None and f.n_cells >= max(4, (f.degree + 1) ** 2 + 2)
    assert an.fit_shells(bins.filter("h > 1.5 and abs(k) < 0.3 and abs(l) < 0.3"), vols, shells, base, BIN).count() == 0
    assert an.fit_shells(bins, vols, shells.limit(0), base, BIN).count() == 0


def test_robust_ridge_ignores_outliers():
    r = np.random.default_rng(4)
    d = r.normal(size=(200, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    x = an.harmonics(*d.T, 2)
    beta = np.array([10, 1, -2, 0.5, 0, 0, 1, 0, 0.3])
    y = x @ beta + 0.01 * r.normal(size=200)
    y[:20] += 50
    got, cov, _ = an.robust_ridge(x, y, np.ones(200), 1e-6)
    assert np.abs(got - beta).max() < 0.6 and np.all(np.linalg.eigvalsh(cov) > -1e-12)
    plain = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(got - beta).max() < np.abs(plain - beta).max() / 3
