import numpy as np
import pytest

from gridloom.llm import whitening


def residual(a, d, q):
    scale = max(np.abs(a).max(), 1e-300)
    return max(np.abs(q @ np.diag(d) @ q.T - a).max() / scale, np.abs(q.T @ q - np.eye(len(d))).max())


@pytest.mark.parametrize("seed", range(8))
def test_rank_one_updates_with_equal_values_and_untouched_directions(seed):
    r = np.random.default_rng(seed)
    k = int(r.integers(1, 20))
    d, q, a = np.zeros(k), np.eye(k), np.zeros((k, k))
    for step in range(80):
        v = r.integers(-3, 4, k).astype(float) * 10.0 ** r.integers(-4, 5)
        if step % 3 == 0:
            v[r.random(k) < 0.7] = 0
        if step % 7 == 0:
            v = q[:, 0].copy()
        rho = float(r.random())
        d, q = whitening.rank_one(d, q, v, rho)
        a += rho * np.outer(v, v)
    assert residual(a, d, q) < 1e-12
    np.testing.assert_allclose(d, np.linalg.eigvalsh(a), rtol=0, atol=1e-12 * d[-1])


def test_spectra_of_parts_combine():
    r = np.random.default_rng(1)
    x = (r.normal(size=(300, 9)) * np.arange(1, 10) * 5).astype(np.int64) + whitening.OFFSET
    parts = []
    for rows in (x[:1], x[1:120], x[120:121], x[121:], x[:0]):
        s = whitening.Spectrum(9)
        for v in rows:
            s.take(v)
        parts.append(s)
    s = whitening.Spectrum(9)
    for p in parts:
        s.combine(p)
    a = (x - x.mean(0)).T @ (x - x.mean(0))
    assert s.n == 300 and (s.sums == x.sum(0)).all() and residual(a, s.values, s.vectors) < 1e-12


def brute(rows):
    """(vec_id, component, deviation) -> whitened up to the sign; n; explained."""
    x = np.array([np.floor(64 * np.array(v, float)) for _, v in rows]).astype(object).astype(np.int64) + 1000000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (n * fit - sums) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(16, int((e > 1e-10 * e[0]).sum()))
    w = ((n * x - sums) / n) @ q[:, :k] / np.sqrt(e[:k])
    dev = [sum(int(t) ** 2 for t in r) for r in n * x - sums]
    return n, e[:k] / e.sum(), w, dev


def check(df, rows):
    n, explained, w, dev = brute(rows)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    assert len(got) == len(rows) * len(explained)
    out = np.array([[got[i, c + 1].whitened for c in range(len(explained))] for i, _ in rows])
    sign = np.sign((out * w).sum(0))
    np.testing.assert_allclose(out * sign, w, atol=1e-6)
    for (i, _), d in zip(rows, dev):
        for c, share in enumerate(explained):
            r = got[i, c + 1]
            assert r.n == n and r.deviation == d and abs(r.explained / share - 1) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_whole_table_matches_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_copies_nulls_lengths_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    r = np.random.default_rng(3)
    rows = [(k, [float(v) for v in r.normal(size=5)]) for k in range(40)]
    rows += [(100 + k, rows[0][1]) for k in range(60)] + [(300, rows[1][1]), (None, rows[2][1])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("-inf")] * 5), (204, [1.0, 2.0]), (205, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "'x' as component").repartition(7)
    check(df, rows)


def test_few_distinct_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([(1, None)])).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(make([(1, []), (2, [])])).collect() == []
    got = sorted(whitening.whiten(make([(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0])])).collect())
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [(1, 1, 2, 128**2), (2, 1, 2, 128**2), (2, 1, 2, 128**2)]
    assert [round(abs(r.whitened), 9) for r in got] == [1.0] * 3 and got[0].explained == pytest.approx(1)


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [4.0e7]), (2, [-4.0e7])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in got] == [None, None] and all(abs(abs(r.whitened) - 1) < 1e-9 for r in got)
