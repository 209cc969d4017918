import random
from collections import Counter

import numpy as np
from helpers import EDGE, frame, prose, words

from gridloom.llm import components, minhash


def shingles(text):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 0


def brute(rows):
    """doc_id -> least doc_id of its group, by all pairs."""
    best = {d: d for d, _ in rows}

    def root(x):
        while best[x] != x:
            x = best[x]
        return x

    sh = [(d, shingles(t)) for d, t in rows]
    for i, (d, a) in enumerate(sh):
        for e, b in sh[:i]:
            if a and b and similarity(a, b) >= 0.8:
                x, y = sorted((root(d), root(e)))
                best[y] = x
    return {d: root(d) for d, _ in rows}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_groups_match_brute_force(spark):
    base = prose(100, 400)
    rows = [(d, t) for d, t, *_ in EDGE if d is not None]
    rows += [(100 + i, edited(base, 1 + i % 9, i)) for i in range(40)]  # many differ among themselves below 0.8
    rows += [(200, base), (201, base + " "), (202, prose(101, 200)), (203, prose(101, 190)), (204, prose(101, 120))]
    rows += [(210, "x y z"), (211, "x  y z"), (212, "x y q")]
    got = minhash.classes(frame(spark, [*rows, (None, base)], extra=True)).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    kept = minhash.keep(frame(spark, rows, extra=True)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert minhash.classes(frame(spark, rows).limit(0)).count() == 0


def test_chained_bucket_takes_several_rounds(spark):
    # a - b - c - d: neighbours are similar, the ends are not
    w = prose(7, 300).split()
    rows = [(i, " ".join(w[12 * i : 12 * i + 240])) for i in range(6)]
    assert {r.doc_id: r.class_id for r in minhash.classes(frame(spark, rows)).collect()} == brute(rows)


def test_real_table_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    one = np.ones
    for share in (0.3, 0.8):
        common, own = int(600 * share), int(600 * (1 - share))
        pool = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
        a, b = pool[: common + own], np.concatenate([pool[:common], pool[common + own :]])
        row = np.repeat([0, 1], [len(a), len(b)])
        sig = minhash.signatures(row, np.concatenate([a, b]), one(len(row)), 2, 2000)
        assert abs((sig[0] == sig[1]).mean() - common / (common + 2 * own)) < 0.04
    tiny = minhash.signatures(np.array([0, 2]), pool[:2], one(2), 3, 120)
    assert np.isfinite(tiny[[0, 2]]).all() and np.isinf(tiny[1]).all()


def test_signatures_take_any_positive_weights():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    for scale in (0.01, 1.0, 40.0):  # whole numbers or not, far below or above one
        w = np.stack([rng.gamma(0.7, scale, 300), rng.gamma(0.7, scale, 300)]) + 1e-9
        w[1, :200] = w[0, :200]
        sig = minhash.signatures(np.repeat([0, 1], 300), np.tile(pool, 2), w.ravel(), 2, 3000)
        want = w.min(axis=0).sum() / w.max(axis=0).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_large_buckets_lose_no_link(spark, monkeypatch):
    # one base, many edited copies and copies of copies: buckets above FEW go by leaders and differences
    monkeypatch.setattr(minhash, "FEW", 2)
    base = prose(500, 150)
    rows = [(i, edited(base, 1 + i % 7, i)) for i in range(60)]
    rows += [(100 + i, edited(rows[i][1], 3, 900 + i)) for i in range(20)]
    rows += [(200 + i, " ".join(rows[i][1].split()[: 132 + i % 9])) for i in range(20)]  # smaller than their leader
    got = {r.doc_id: r.class_id for r in minhash.classes(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 140)] + [(50, 50)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}}


def test_keep_loses_no_document_that_shares_an_id(spark):
    base = prose(1, 100)
    rows = [(1, base), (1, prose(2, 100)), (2, prose(3, 100)), (3, edited(base, 2, 5)), (3, prose(4, 100)), (4, prose(3, 100)), (5, prose(6, 80)), (5, prose(6, 80)), (6, None), (6, "")]
    kept = sorted((r.doc_id, r.text or "") for r in minhash.keep(frame(spark, rows, extra=True)).collect())
    texts = [t for _, t in kept]
    for t in (prose(2, 100), prose(4, 100), prose(3, 100), prose(6, 80)):  # linked to nothing, or first of their copies
        assert texts.count(t) == 1
    assert (2, prose(3, 100)) in kept and sum(t in (base, edited(base, 2, 5)) for t in texts) == 1
    assert [r for r in kept if r[0] == 6] in ([(6, "")], [(6, ""), (6, "")])
