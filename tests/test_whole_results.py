"""Queries that return whole maps and volumes, against brute force on all bins of the small tables."""

import duckdb
import numpy as np
import pytest

from gridloom.plans import registry
from gridloom.plans.catalogue import _POSITIONS
from gridloom.sources import bins as src

SF = "/root/testdata/sf0.001"
SHAPE = (21, 21, 11)


@pytest.fixture(scope="module")
def grids():
    """volume -> (intensity, present and measured), as arrays."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    out = {x: (np.zeros(SHAPE), np.zeros(SHAPE, bool)) for x in "ANR"}
    for x, i, j, k, value, ok in con.execute(src.BINS_SQL + " SELECT volume_id, ih, ik, il, intensity, measured FROM bins").fetchall():
        out[x][0][i, j, k], out[x][1][i, j, k] = value, ok
    return out


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def hann_map(data, ok):
    w = 1.0
    for a, n in enumerate(SHAPE):
        w = w * (0.5 * (1 + np.cos(np.pi * (2 * np.arange(n) / (n - 1) - 1)))).reshape([-1 if a == x else 1 for x in range(3)])
    w = np.where(ok, w, 0.0)
    return np.fft.fftshift(np.fft.fftn(np.fft.ifftshift((data - (w * data).sum() / w.sum()) * w))).real


def test_whole_map(spark, grids):
    rows = run(spark, "dom_delta_pdf_map")
    assert len(rows) == 3 * 21 * 21 * 11
    want = {x: hann_map(*g) for x, g in grids.items()}
    assert all(abs(r.value - want[r.volume_id][r.ix, r.iy, r.iz]) < 1e-5 for r in rows)
    assert all(abs(r.x - (r.ix - 10) / 4.2) < 1e-6 and abs(r.z - (r.iz - 5) / 2.2) < 1e-6 for r in rows)


def test_whole_regridded_volume(spark, grids):
    rows = run(spark, "dom_regrid_volume")
    assert len({(r.volume_id, r.ih, r.ik, r.il) for r in rows}) == len(rows) == 3 * 21 * 21 * 11
    for r in rows:
        data, ok = grids[r.volume_id]
        at = {10 + (r.ih - 10) // 2, 10 - (10 - r.ih) // 2}
        held = all(ok[i, r.ik, r.il] for i in at)
        assert r.measured == held and abs(r.intensity - (np.mean([data[i, r.ik, r.il] for i in at]) if held else 0)) < 1e-6


def test_nearest_position_of_all_measured_bins(spark, grids):
    rows = run(spark, "flt_nearest_positions")
    assert len(rows) == sum(ok.sum() for _, ok in grids.values())
    for r in rows:
        assert grids[r.volume_id][1][r.ih, r.ik, r.il]
        h, k, l = (r.ih - 10) / 5, (r.ik - 10) / 5, (r.il - 5) / 5
        d = {p: abs((fh * h + fk * k + fl * l - c + w / 2) % w - w / 2) for p, fh, fk, fl, c, _, w in _POSITIONS}
        assert abs(r.distance - min(d.values())) < 2e-6 and d[r.position_id] < min(d.values()) + 1e-9


def test_ring_models_give_profiles_and_removed_sums(spark, grids):
    cells, total = {}, 0.0
    for r in run(spark, "dom_pooled_rings"):
        data, ok = grids[r.volume_id]
        if ok[r.ih, r.ik, r.il]:
            h, k, l = (r.ih - 10) / 5, (r.ik - 10) / 5, (r.il - 5) / 5
            at = (r.volume_id, r.ih, int(np.sqrt((1.4 * h) ** 2 + (1.4 * k) ** 2 + (1.2 * l) ** 2) / 0.25))
            cells.setdefault((*at, "raw"), []).append((data[r.ih, r.ik, r.il], 0.0))
            cells.setdefault((*at, "pooled"), []).append((r.intensity, r.removed))
            total += r.removed
    rows = run(spark, "dom_ring_profiles")
    got = {(r.volume_id, r.ih, r.shell, r.model): r for r in rows}
    assert got.keys() == cells.keys() and len(rows) == len(got)
    for key, x in cells.items():
        assert got[key].n == len(x) and abs(got[key].median - np.median([y for y, _ in x])) < 1e-5 and abs(got[key].removed - sum(y for _, y in x)) < 1e-3
    assert total > 0 and abs(sum(r.removed for r in rows) - total) < 1e-3 and all(r.removed == 0 for r in rows if r.model == "raw")


def regions(points):
    """Lists of bins that touch by a face, an edge or a corner."""
    left, out = set(points), []
    while left:
        todo, one = [left.pop()], []
        while todo:
            i, j, k = todo.pop()
            one.append((i, j, k))
            near = {(i + a, j + b, k + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(one)
    return out


def test_hole_sizes_and_largest_holes(spark):
    holes = {}
    for r in run(spark, "dom_punch"):
        holes.setdefault(r.volume_id, []).append((r.ih, r.ik, r.il))
    holes = {x: regions(p) for x, p in holes.items()}
    got = {r.volume_id: r for r in run(spark, "dom_hole_sizes")}
    assert got.keys() == holes.keys()
    for x, r in got.items():
        n = np.array([len(p) for p in holes[x]])
        assert (r.n_holes, r.n_bins) == (len(n), n.sum()) and abs(r.share_of_grid - n.sum() / 4851) < 1e-5
        assert np.allclose([r.size_p50, r.size_p90, r.size_p99, r.size_p100], np.percentile(n, [50, 90, 99, 100]), atol=1e-5)
        assert abs(r.share_over_30 - n[n > 30].sum() / n.sum()) < 1e-5 and abs(r.share_over_100 - n[n > 100].sum() / n.sum()) < 1e-5
    for x in holes:
        top = sorted((r for r in run_largest(spark) if r.volume_id == x), key=lambda r: r.place)
        assert [r.n for r in top] == sorted((len(p) for p in holes[x]), reverse=True)[:5]
        centres = {(len(p), *np.round((np.mean(p, axis=0) - (10, 10, 5)) / 5, 4)) for p in holes[x]}
        assert all((r.n, *np.round((r.h, r.k, r.l), 4)) in centres for r in top)


def run_largest(spark, memo=[]):  # noqa: B006
    if not memo:
        memo.extend(run(spark, "dom_largest_holes"))
    return memo


def test_pair_values_are_read_from_the_map(spark, grids):
    rows = run(spark, "dom_pair_values")
    step = np.array([1 / 4.2, 1 / 4.2, 1 / 2.2])
    mid = np.array([10, 10, 5])
    sites = {"a": np.zeros(3), "b": np.full(3, 0.5), "c": np.array([0.25, 0.0, 0.75])}
    want = {(s, t, *np.round((sites[t] - sites[s]) % 1 + (a, b, c), 6)) for s in sites for t in sites if s != t
            for a in range(-4, 5) for b in range(-4, 5) for c in range(-4, 5) if (np.abs((sites[t] - sites[s]) % 1 + (a, b, c)) <= mid * step + 1e-9).all()}
    assert {(r.site, r.site2, r.x, r.y, r.z) for r in rows} == want and len(rows) == 3 * len(want)
    at = (np.indices(SHAPE).reshape(3, -1).T - mid) * step
    out = np.sqrt((at**2).sum(1)) > 0.05 * (mid * step).min()
    for x, g in grids.items():
        m = hann_map(*g)
        v = m.ravel()[out]
        sigma = 1.4826 * np.median(np.abs(v - np.median(v)))
        for r in rows:
            if r.volume_id == x:
                t = np.array([r.x, r.y, r.z]) / step + mid
                i = np.minimum(np.floor(t + 1e-6).astype(int), np.array(SHAPE) - 2)
                w = np.clip(t - i, 0, 1)
                value = sum(m[tuple(i + c)] * np.prod(np.where(c, w, 1 - w)) for c in np.ndindex(2, 2, 2))
                assert r.in_sigma is not None and abs(r.in_sigma - value / sigma) < 1e-3
