"""Rings that share a texture: rank-one factors against numpy, planted rings that go."""

import numpy as np
import pytest
from planted import frames

from gridloom.operators import texture as tx

UB, STEP, SHAPE, HALF = np.eye(3), 0.06, (61, 61, 31), 0.12


def shared(phi):
    return 1 + 0.4 * np.cos(phi) - 0.3 * np.sin(2 * phi)


@pytest.fixture(scope="module")
def planted(spark):
    grid = np.stack(np.meshgrid(*[(np.arange(n) - n // 2) * STEP for n in SHAPE], indexing="ij"), -1)
    q, phi = np.linalg.norm(grid, axis=-1), np.arctan2(grid[..., 1], grid[..., 0])
    rings = sum(a * shared(phi) * np.exp(-0.5 * ((q - q0) / (HALF / 2)) ** 2) for q0, a in ((0.8, 60.0), (1.4, 30.0)))
    data = 20 + rings + 0.2 * np.random.default_rng(0).normal(size=SHAPE)
    bins, vols = frames(spark, data, STEP, UB)
    r = spark.createDataFrame([("v", 1, 0.8), ("v", 2, 1.4)], "volume_id string, ring_id int, q0 double")
    return bins.selectExpr("*", "sqrt(h*h + k*k + l*l) as q").cache(), vols, r, q, rings


def test_factors_equal_the_first_singular_pair():
    r = np.random.default_rng(1)
    for shape in ((3, 8), (12, 5), (1, 4), (6, 1)):
        v = np.outer(r.uniform(1, 5, shape[0]), r.uniform(0.5, 2, shape[1])) + 0.2 * r.normal(size=shape)
        a, t = tx.rank_one(v, np.ones(shape, bool))
        u, s, w = np.linalg.svd(v)
        assert np.allclose(np.outer(a, t), s[0] * np.outer(u[:, 0], w[0]), atol=1e-8) and abs(t.mean() - 1) < 1e-9
    v, known = np.outer([1, 2, 3.0], [1, 0.5, 1.5, 1]), np.ones((3, 4), bool)
    known[0, 1] = known[2, 3] = False
    a, t = tx.rank_one(np.where(known, v, 99), known)
    assert np.allclose(np.outer(a, t), v, atol=1e-6)
    assert not tx.rank_one(np.zeros((2, 3)), np.zeros((2, 3), bool))[0].any()


def test_planted_rings_share_a_texture_and_go(spark, planted):
    bins, vols, rings, q, model = planted
    amplitudes = tx.patch_amplitudes(bins, vols, rings, half=HALF / 2, flank=0.35).cache()
    assert amplitudes.count() == 48
    f = tx.factored_rings(amplitudes).first()
    phi = np.array(f.patches) * 2 * np.pi / 24
    assert f.share > 0.99 and np.abs(np.array(f.texture) - shared(phi)).max() < 0.12 and 1.6 < f.amplitudes[0] / f.amplitudes[1] < 2.4
    factors = tx.factored_rings(amplitudes)
    out = tx.remove_factored(bins, vols, rings, factors, half=HALF)
    got = np.zeros(SHAPE)
    for r in out.select("ih", "ik", "il", "removed").collect():
        got[r.ih, r.ik, r.il] = r.removed
    on = (np.abs(q - 0.8) < 0.05) | (np.abs(q - 1.4) < 0.05)
    assert np.abs(got - model)[on].sum() < 0.35 * model[on].sum() and np.corrcoef(got[on], model[on])[0, 1] > 0.95
    masked = tx.remove_factored(bins, vols, rings, factors, half=HALF, limit=10.0)
    assert masked.filter("not measured").count() == int((got >= 10).sum())
    assert out.filter("sigma < 1").count() == 0


def test_edges(spark, planted):
    bins, vols, rings, *_ = planted
    assert tx.patch_amplitudes(bins, vols, rings.limit(0)).count() == 0
    assert tx.factored_rings(tx.patch_amplitudes(bins.limit(0), vols, rings)).count() == 0
    with pytest.raises(ValueError):
        tx.patch_amplitudes(bins, vols, rings, overlap=0.7)
