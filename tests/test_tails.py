"""The tail sweep on planted tails, rods, halos and clean nodes."""

import itertools

import numpy as np
import pytest
from planted import frames, index_of

from gridloom.operators import shapes as sp
from gridloom.operators import tails as tl

UB, STEP, SHAPE = np.eye(3) * 1.5, 0.05, (61, 61, 61)
EDGE, HOLE = 0.075, 0.14
NODES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, 0, 1), (0, -1, 0), (1, 1, 0)]


def bump(grid, centre, sigma, height):
    return height * np.exp(-0.5 * ((grid - centre) ** 2).sum(-1) / sigma**2)


@pytest.fixture(scope="module")
def planted(spark):
    grid = np.stack(np.meshgrid(*[(np.arange(n) - n // 2) * STEP for n in SHAPE], indexing="ij"), -1) @ UB.T
    data = 10 + 0.5 * np.random.default_rng(0).normal(size=SHAPE)
    halo = sum(12 * np.exp(-np.linalg.norm(grid - UB @ n, axis=-1) / 0.25) for n in map(np.array, NODES))
    data = data + halo
    for n in NODES:
        data += bump(grid, UB @ np.array(n), 0.05, 1000)
    data += bump(grid, UB @ np.array([1, 0, 0]) + [0, 0.2, 0], 0.04, 250)  # a tail along +y of a turn about z
    rod = (np.abs(grid[..., 1] - 1.5) < 0.06) & (np.abs(grid[..., 2]) < 0.06)  # a rod along x through (0, 1, 0)
    data[rod] += 80
    data += bump(grid, UB @ np.array([0, -1, 0]) + [-0.2, 0, 0], 0.04, 250) * 0.05  # under the gate in this volume's σ
    holes = spark.createDataFrame(
        [("v", k + 1, *n, *index_of(n, SHAPE, STEP), *map(float, n), (UB.T @ UB / HOLE**2).ravel().tolist()) for k, n in enumerate(NODES)],
        "volume_id string, peak_id long, nh int, nk int, nl int, ih int, ik int, il int, ch double, ck double, cl double, shape array<double>",
    )
    bins, vols = frames(spark, data, STEP, UB, sigma=6.0)
    bins = sp.punch_shapes(bins, holes, vols).selectExpr("*", "1.5 * sqrt(h*h + k*k + l*l) as q").cache()
    turn = spark.createDataFrame([("v", 0.0, 0.0, 0.1)], "volume_id string, wx double, wy double, wz double")
    return bins, vols, holes, turn, grid, halo


def test_tail_goes_and_the_rest_stays(spark, planted):
    bins, vols, holes, turn, grid, halo = planted
    nodes, added = tl.sweep_tails(bins, vols, holes, turn)
    got = {r.peak_id: r for r in nodes.collect()}
    assert set(got) == {1, 2, 3, 5, 6}  # (0, 0, 1) lies on the axis of the turn and does not move
    assert got[1].status == "swept" and got[2].status == "clean" and got[3].status == "extended" and got[5].status == "clean"
    assert abs(got[1].shift - 0.15) < 1e-9 and got[1].removed == got[1].tail_before >= 5 and got[1].excess_removed == pytest.approx(got[1].excess_before)
    at = np.array([tuple(r) for r in added.select("ih", "ik", "il").collect()])
    where = grid[tuple(at.T)]
    assert np.all(np.linalg.norm(where - [1.5, 0.2, 0], axis=1) < 0.2)
    near = (np.linalg.norm(grid - [1.5, 0, 0], axis=-1) < 0.5) & (np.linalg.norm(grid - [1.5, 0, 0], axis=-1) > HOLE)
    gone = np.zeros(SHAPE, bool)
    gone[tuple(at.T)] = True
    assert halo[near & ~gone].sum() > 0.85 * halo[near].sum()
    after = tl.apply_sweep(bins, added)
    assert after.filter("punched").count() == bins.filter("punched").count() + len(at)


def test_protection_guard_and_caps(spark, planted, monkeypatch):
    bins, vols, holes, turn, *_ = planted
    one = holes.filter("peak_id = 1")
    status = lambda b, h: tl.sweep_tails(b, vols, h, turn)[0].first().status
    assert status(bins.selectExpr("*", "k > 0.05 as protected"), one) == "clean"
    inside = tl.sweep_tails(bins, vols, one.selectExpr("*", "0.01D as guard"), turn)[1].select("ih").distinct().collect()
    assert [r.ih for r in inside] == [50]  # no bin beside the node's own plane
    assert status(bins, one.selectExpr("*", "array(0D, 0.1D, 0D) as stretch")) in ("swept", "clean", "extended")
    monkeypatch.setattr(tl, "SHELL_SHARE", 0.0)
    nodes, added = tl.sweep_tails(bins, vols, one, turn)
    assert nodes.first().status == "shell_capped" and added.count() == 0
    none = turn.selectExpr("volume_id", "0D as wx", "0D as wy", "0D as wz")
    assert tl.sweep_tails(bins, vols, holes, none)[0].count() == 0


def test_growth_and_distance_by_brute_force():
    r = np.random.default_rng(3)
    mask = r.random((7, 8, 6)) < 0.45
    seed = np.zeros_like(mask)
    seed[3, 4, 2] = mask[3, 4, 2] = True
    want, todo = {(3, 4, 2)}, [(3, 4, 2)]
    while todo:
        p = todo.pop()
        for s in itertools.product((-1, 0, 1), repeat=3):
            q = tuple(np.add(p, s))
            if all(0 <= x < n for x, n in zip(q, mask.shape)) and mask[q] and q not in want:
                want.add(q)
                todo.append(q)
    assert set(map(tuple, np.argwhere(tl.grown(seed, mask)))) == want
    assert tl.grown(seed, np.ones_like(mask), 1).sum() == 27
    own, e = r.random((5, 6, 4)) < 0.1, np.array([0.1, 0.2, 0.3])
    p, o = np.argwhere(np.ones_like(own)) * e, np.argwhere(own) * e
    assert np.allclose(tl.distance_to(own, e).ravel(), np.sqrt(((p[:, None] - o) ** 2).sum(-1)).min(1))
    d = r.normal(size=(50, 3))
    a, s = np.diag([1, 4, 2.0]), np.array([0.5, 0.2, 0])
    t = np.linspace(-1, 1, 4001)
    least = np.array([min(((x - u * s) @ a * (x - u * s)).sum() for u in t) for x in d])
    assert ((least <= 1) == tl.in_capsule(d, a, s)).all()
