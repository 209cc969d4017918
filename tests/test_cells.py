"""Cells, Laue classes, rotations and orientation fits against planted truths and brute force."""

import math

import numpy as np
import pytest

from gridloom.functions import form_factor as ff
from gridloom.operators import cells as ce
from gridloom.operators import shells as sh

START = np.diag([1.4, 1.4, 1.2])


def turn(axis, degrees):
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    t = math.radians(degrees)
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k


def centres(spark, ub, wrong=()):
    """Centres of all nodes up to 2 in the lattice units of START, when the crystal's matrix is ub."""
    rows = []
    for n in [(h, k, l) for h in range(-2, 3) for k in range(-2, 3) for l in range(-2, 3) if (h, k, l) != (0, 0, 0)]:
        c = np.linalg.inv(START) @ ub @ np.array(n) + (0.25 if n in wrong else 0.0)
        rows.append(("v", START.ravel().tolist(), *map(float, c), *n, 1.0))
    return spark.createDataFrame(rows, "volume_id string, ub array<double>, ch double, ck double, cl double, nh int, nk int, nl int, w double")


@pytest.mark.parametrize("kind", ["orientation", "both"])
def test_ub_fit_finds_a_planted_turn(spark, kind):
    ub = turn((1, 2, 3), 1.5) @ START
    r = ce.ub_fit(centres(spark, ub, {(1, 0, 0), (0, 2, 1)}), kind).first()
    assert (r.n, r.used) == (124, 122)
    assert np.allclose(np.array(r.fitted).reshape(3, 3), ub, atol=1e-9)
    assert abs(r.angle - 1.5) < 1e-6


def test_ub_fit_finds_a_planted_cell(spark):
    ub = START * np.array([1.02, 1.0, 0.99])
    for kind in ("both", "lattice"):
        r = ce.ub_fit(centres(spark, ub), kind).first()
        assert np.allclose(np.array(r.fitted).reshape(3, 3), ub, atol=1e-9)


def test_ub_fit_with_too_few_centres_and_nulls(spark):
    c = centres(spark, START).limit(2).unionByName(centres(spark, START).limit(3).selectExpr("volume_id", "ub", "cast(null as double) ch", "ck", "cl", "nh", "nk", "nl", "w"))
    r = ce.ub_fit(c).first()
    assert r.fitted is None and r.n == 2
    assert ce.ub_fit(c.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ce.ub_fit(c, "shape")


def offsets(spark, omega, noise=0.0, wrong=0):
    rng, rows = np.random.default_rng(5), []
    for i, n in enumerate([(h, k, l) for h in range(-2, 3) for k in range(-2, 3) for l in range(-2, 3) if (h, k, l) != (0, 0, 0)]):
        q = START @ np.array(n)
        d = np.cross(omega, q) + noise * rng.normal(size=3) + (1.0 if i < wrong else 0.0)
        rows.append(("v", *map(float, q), *map(float, d), 1.0))
    return spark.createDataFrame(rows, "volume_id string, qx double, qy double, qz double, dx double, dy double, dz double, w double")


def test_rotation_diagnosis(spark):
    r = ce.rotation_diagnosis(offsets(spark, (0.02, -0.01, 0.03), 0.002, wrong=4), 0.1).first()
    assert r.rejected >= 4 and r.status == "active" and r.p < 1e-6
    assert np.allclose((r.wx, r.wy, r.wz), (0.02, -0.01, 0.03), atol=1e-3)
    assert ce.rotation_diagnosis(offsets(spark, (0.02, -0.01, 0.03), 0.002), 1.0).first().status == "unresolved"
    assert ce.rotation_diagnosis(offsets(spark, (0, 0, 0), 0.02), 0.1).first().status == "not_significant"


def by_rounds(q, d, w, reject, within, least, rounds):
    """The rotation of one volume and which offsets it keeps, round by round with numpy."""
    d = d - ((d * q).sum(1) / (q * q).sum(1))[:, None] * q
    used = np.ones(len(q), dtype=bool)

    def fit():
        m = sum(c * (x @ x * np.eye(3) - np.outer(x, x)) for x, c in zip(q[used], w[used], strict=True))
        return np.linalg.solve(m, (w[used, None] * np.cross(q[used], d[used])).sum(0)) if np.linalg.det(m) > 1e-8 * np.trace(m) ** 3 else None

    for _ in range(rounds):
        if (o := fit()) is None:
            break
        r = np.linalg.norm(d - np.cross(o, q), axis=1)
        kept = r <= max(reject * np.median(r[used]), within)
        used = kept if kept.sum() >= least else used
    return fit(), used


@pytest.mark.parametrize("rounds, within, least", [(5, 0.0, 4), (2, 0.0, 4), (5, 0.05, 4), (5, 0.0, 12), (0, 0.0, 4)])
def test_rotations_of_many_volumes_round_by_round(spark, rounds, within, least):
    rng, rows, want = np.random.default_rng(7), [], {}
    for v in range(40):
        n = int(rng.integers(3, 60))
        q = rng.normal(size=(n, 3)) * (1, 1, 0 if v % 10 == 9 else 1)
        q = q * (1, 0, 0) if v % 10 == 8 else q  # one direction only
        d = np.cross((0.02, -0.01, 0.03), q) + rng.normal(size=(n, 3)) * 0.01 * 10.0 ** rng.integers(0, 3, size=(n, 1))
        w = rng.random(n) + 0.5
        want[f"v{v}"] = (q, *by_rounds(q, d, w, 2.0, within, least, rounds))
        rows += [(f"v{v}", *map(float, (*a, *b, c))) for a, b, c in zip(q, d, w, strict=True)]
    o = spark.createDataFrame([*rows, (None, *rows[0][1:])], "volume_id string, qx double, qy double, qz double, dx double, dy double, dz double, w double")
    got = {r.volume_id: r for r in ce.rotation_diagnosis(o, 0.1, 2.0, within, least, rounds=rounds).collect()}
    assert got.keys() == want.keys()
    for v, (q, omega, used) in want.items():
        assert (got[v].n, got[v].rejected) == (used.sum(), (~used).sum())
        assert got[v].wx is None if omega is None else np.allclose((got[v].wx, got[v].wy, got[v].wz), omega, atol=1e-9)
        assert omega is None or math.isclose(got[v].max_shift, np.linalg.norm(np.cross(omega, q), axis=1).max(), rel_tol=1e-9)
    if rounds == 5 and not within and least == 4:
        assert max(r.rejected for r in got.values()) > 5


def test_rotation_about_one_direction_is_not_fitted(spark):
    o = offsets(spark, (0.01, 0.0, 0.0)).filter("qy = 0 and qz = 0")
    r = ce.rotation_diagnosis(o, 0.1).first()
    assert r.wx is None and r.p is None and r.status == "not_significant"


def test_tail_of_f():
    # upper points of the F distribution from printed tables
    got = ce.beyond([3.708, 8.660, 2.605, 6.552, 0.0], [3, 3, 3, 3, 3], [10, 3, 1000000, 10, 7])
    assert np.allclose(got, [0.05, 0.0548, 0.05, 0.01, 1.0], atol=2e-4)


def test_closure_orders():
    orders = {"-1": 2, "2/m (b unique)": 4, "2/m (c unique)": 4, "mmm": 8, "4/m": 8, "4/mmm": 16, "-3": 6, "-3m1": 12, "-31m": 12, "6/m": 12, "6/mmm": 24, "m-3": 24, "m-3m": 48}
    assert {n: len(ce.laue_operations(n)) for n in ce.LAUE_CLASSES} == orders


def test_candidates_without_ub_and_with_null_axes(spark):
    rows = [("none", None, -2.0, -2.0, -1.0, 0.2, 0.2, 0.2), ("axis", START.ravel().tolist(), None, -2.0, -1.0, 0.2, 0.2, 0.2)]
    v = spark.createDataFrame(rows, "volume_id string, ub array<double>, h0 double, k0 double, l0 double, dh double, dk double, dl double")
    got = {(r.volume_id, r.laue): r for r in ce.laue_candidates(v).collect()}
    assert got["none", "m-3m"].allowed and got["none", "m-3m"].change is None
    assert got["axis", "mmm"].reason == "grid" and got["axis", "m-3m"].reason == "metric"


def test_terms_come_back(spark):
    c = ff.IONS["Tb3+"]
    f = spark.range(12).selectExpr("'v' volume_id", "0.4 + id * 0.25 q", "100L n_measured")
    f = f.withColumn("floor", 5.0 + 20.0 * ff.form_factor(f.q, c) ** 2 + 0.7 * f.q * f.q)
    r = sh.fit_terms(f, 0.0, 9.0, c).first()
    assert np.allclose((r.const, r.c, r.b, r.r2), (5.0, 20.0, 0.7, 1.0), atol=1e-6)
    r = sh.fit_terms(f.filter("q < 0.7"), 0.0, 9.0, c).first()  # two shells for three terms: their mean
    assert r.c == 0 and r.b == 0 and r.r2 is None and abs(r.const - f.filter("q < 0.7").agg({"floor": "avg"}).first()[0]) < 1e-9
    flat = sh.fit_terms(f.withColumn("floor", 3.0 + 0.5 * f.q * f.q), 0.0, 9.0).first()
    assert np.allclose((flat.const, flat.c, flat.b), (3.0, 0.0, 0.5), atol=1e-9)


def test_ion_names():
    assert ff.ion_name("tb3") == ff.ion_name("Tb^3+") == "Tb3+" and ff.ion_name("none") is None and ff.ion_name(None) is None
    with pytest.raises(ValueError):
        ff.ion_name("Xx2+")
