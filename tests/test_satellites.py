"""Bunching at a commensurate fraction and the second-grain check, on planted peaks and by brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from gridloom.operators import satellites as sa

N, STEP = 61, 0.05
MMM = tuple((a, 0, 0, 0, b, 0, 0, 0, c) for a in (1, -1) for b in (1, -1) for c in (1, -1))


def volumes(spark, ub=np.eye(3), name="v"):
    row = (name, N, N, N, *[x for _ in range(3) for x in (-(N // 2) * STEP, STEP)], np.array(ub, float).ravel().tolist())
    return spark.createDataFrame([row], "volume_id string, nh int, nk int, nl int, h0 double, dh double, k0 double, dk double, l0 double, dl double, ub array<double>")


def peaks(spark, rows, name="v"):
    return spark.createDataFrame([(name, *map(float, r)) for r in rows], "volume_id string, h double, k double, l double")


def satellites(seed=0, n=12):
    r = np.random.default_rng(seed)
    return [(r.integers(-1, 2) + r.choice([1 / 3, -1 / 3]) + r.uniform(-0.01, 0.01), *r.integers(-1, 2, 2)) for _ in range(n)]


def brute(points, q, axis):
    """(hits, mean distance, chance) of one coordinate and denominator, fraction by fraction."""
    x = (np.arange(N) - N // 2) * STEP
    g = np.stack(np.meshgrid(x, x, x, indexing="ij"), -1).reshape(-1, 3)
    flat = lambda y: np.abs(y - np.rint(y)) <= STEP + 1e-9
    g = g[~flat(g).all(1)]

    def away(y):
        return np.min([np.abs((y - float(Fraction(p, q)) + 0.5) % 1 - 0.5) for p in range(1, q) if math.gcd(p, q) == 1], axis=0)

    pts = np.array([p for p in points if not flat(np.array(p)).all()])
    d = away(pts[:, axis])
    hit = d <= STEP + 1e-9
    return int(hit.sum()), d[hit].mean() if hit.any() else None, (away(g[:, axis]) <= STEP + 1e-9).mean(), len(pts)


def test_planted_third_is_found_and_counts_match_brute_force(spark):
    pts = satellites() + [(0.04, 0.0, 1.0)]  # the wing of a node counts for nothing
    c = sa.bunching_counts(peaks(spark, pts), volumes(spark))
    rows = sa.bunching(c).collect()
    assert {(r.coordinate, r.denominator) for r in rows} == {(a, q) for a in "hkl" for q in range(2, 10)}
    for r in rows:
        hits, distance, p0, n = brute(sorted(set(pts)), r.denominator, "hkl".index(r.coordinate))
        assert (r.hits, r.n, r.tests) == (hits, n, 24) and abs(r.p0 - p0) < 1e-12
        assert (r.distance is None) == (distance is None) and (distance is None or abs(r.distance - distance) < 1e-9)
    best = [r for r in rows if r.best]
    assert [(r.coordinate, r.denominator) for r in best] == [("h", 3)] and best[0].fired and best[0].clear and best[0].aside == best[0].hits


def test_random_peaks_do_not_bunch(spark):
    r = np.random.default_rng(5)
    rows = sa.bunching(sa.bunching_counts(peaks(spark, r.uniform(-1.5, 1.5, (40, 3))), volumes(spark))).collect()
    assert rows and not any(x.fired or x.best for x in rows)


def test_orbits_count_once_and_equivalents_are_one_coordinate(spark):
    pts = [(a * 1 / 3, b, c) for a in (1, -1) for b in (1, -1) for c in (1, -1)] + [(a * 4 / 3, b, 0) for a in (1, -1) for b in (1, -1)]
    reps = sa.representatives(peaks(spark, pts), MMM)
    assert reps.count() == 2
    cubic = MMM + tuple((0, a, 0, b, 0, 0, 0, 0, c) for a in (1, -1) for b in (1, -1) for c in (1, -1))
    assert sa.coordinates(cubic) == [(0, ((1, 0, 0), (0, 1, 0))), (2, ((0, 0, 1),))]
    rows = sa.bunching_counts(peaks(spark, pts), volumes(spark), ops=cubic).collect()
    assert {r.coordinate for r in rows} == {"h", "l"} and all(r.n == 2 for r in rows)
    assert next(r for r in rows if r.coordinate == "h" and r.denominator == 3).hits == 2


def test_eligible_bins_and_empty_tables(spark):
    v = volumes(spark)
    some = spark.range(N).selectExpr("'v' as volume_id", "cast(id as int) as ih", "30 as ik", "30 as il")
    rows = sa.bunching_counts(peaks(spark, [(1 / 3, 0, 0), (1 / 3, 1, 0)]), v, eligible=some).collect()
    assert {r.n for r in rows} == {1}
    assert sa.bunching_counts(peaks(spark, [(9, 9, 9)]).limit(0), v).count() == 0


@pytest.mark.parametrize(("k", "n", "p"), [(0, 5, 0.3), (3, 3, 0.5), (7, 12, 0.31), (40, 300, 0.05), (2, 1, 0.5)])
def test_binomial_tail(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert abs(sa.binomial_tail(*(sa.pd.Series([x]) for x in (k, n, p)))[0] - want) < 1e-12


def turn(axis, degrees):
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    t = math.radians(degrees)
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k


def grains(spark, rows, ub, **kw):
    df = spark.createDataFrame([("v", *map(float, r), 100.0 - i) for i, r in enumerate(rows)], "volume_id string, h double, k double, l double, intensity double")
    return sa.grain_check(df, volumes(spark, ub), **kw).first()


def test_planted_grain_is_found_and_the_control_is_below(spark):
    ub = np.diag([1.5, 1.5, 1.1])
    rot = turn((1, 2, 3), 23.0)
    nodes = [(h, k, l) for h in (-2, -1, 0, 1, 2) for k in (-1, 0, 1) for l in (-1, 0, 1, 2) if (h, k, l) != (0, 0, 0)]
    r = np.random.default_rng(1)
    r.shuffle(nodes)
    pts = [np.linalg.inv(ub) @ (rot @ ub @ np.array(n) + r.normal(size=3) * 0.005) for n in nodes[:25]] + list(r.uniform(-2, 2, (5, 3)))
    got = grains(spark, pts, ub)
    assert got.orbits == got.judged == 30 and got.indexed >= 25 and abs(got.misorientation - 23) < 1.0 and got.control < 15


def test_displaced_peaks_are_their_nodes_own(spark):
    ub = np.eye(3) * 1.5
    rot = turn((0, 0, 1), 4.0)
    nodes = [(2, 0, 0), (0, 2, 0), (2, 1, 0), (1, 2, 1), (-2, 1, 1), (1, 1, 0), (2, 2, 1)]
    got = grains(spark, [rot @ np.array(n) for n in nodes], ub)
    assert got.beside_nodes == 7 and 3.0 < got.offset_median <= 4.0 + 1e-6 and got.misorientation < 4.5 and got.indexed == 7
    twice = grains(spark, [rot @ np.array(n) for n in nodes] + [-(rot @ np.array(n)) for n in nodes], ub, ops=((1, 0, 0, 0, 1, 0, 0, 0, 1), (-1, 0, 0, 0, -1, 0, 0, 0, -1)))
    assert twice.orbits == 7
    one = grains(spark, [(0.5, 0.1, 0.2)], ub)
    assert one.judged == 1 and one.indexed == 0 and one.misorientation is None
