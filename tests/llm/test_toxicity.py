import math
import random
import zlib

import numpy as np
from helpers import EDGE, LOREM, frame, prose
from pyspark.sql import functions as F

from gridloom.llm import toxicity as tx


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    for v in np.unique(score):
        order[score == v] = order[score == v].mean()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def made_up(n, seed=0):
    """(documents, labels): a fifth toxic, by words of its own or by a stem in several of its words."""
    r, docs, labels = random.Random(seed), [], []
    for k in range(n):
        w = [r.choice(LOREM) + r.choice(LOREM) for _ in range(r.randrange(30, 120))]
        toxic = k % 5 == 0
        if toxic:
            signs = ["nasty", "vile"] if k % 10 else ["grox" + r.choice(LOREM), "grox" + r.choice(LOREM)]
            for s in signs * 2:
                w.insert(r.randrange(len(w)), s.upper() if k % 3 == 0 else s)
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return docs, labels


def tables(spark, docs, labels):
    return frame(spark, docs, extra=True), spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))


def test_learns_signs_and_leaves_clean_rows_alone(spark):
    docs, labels = made_up(400)
    d, l = tables(spark, docs, labels)
    got = {r.doc_id: r for r in tx.score(d, l).collect()}
    y = dict(labels)
    assert set(got) == set(y) and all(got[k].held_out == held(k) and got[k].predicted == (got[k].score >= 0.5) for k in y)
    assert all(got[k].predicted == y[k] for k in y if held(k)) and sum(got[k].predicted != y[k] for k in y) <= 4
    # what is held out teaches nothing, and neither labels nor other columns are inputs of a score
    turned = [(k, 1 - v if held(k) else v) for k, v in labels]
    d2 = frame(spark, [(k, t, "zz", "other") for k, t in docs])
    again = {r.doc_id: r.score for r in tx.score(d2, tables(spark, docs, turned)[1]).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-12 for k in y)


def test_copies_of_one_toxic_text_teach_no_words(spark):
    docs, labels = made_up(300)
    copies = [(1000 + k, "zebra quagga okapi giraffe tapir lemur nasty vile " + prose(7, 60) + f" n{k % 4}") for k in range(200)]
    d, l = tables(spark, docs + copies, labels + [(k, 1) for k, _ in copies])
    m = tx.train(d, l)
    assert not any(t.startswith(("zebr", "quag", "okap", "tapi", "lemu")) for t in m.lexicon.terms) and any(t.startswith("grox") for t in m.lexicon.terms)


def test_held_out_accuracy_on_the_given_tables(spark):
    for sf, least, right in (("sf0.01", 0.93, 0.97), ("sf0.1", 0.95, 0.98)):
        d, l = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        rows = tx.score(d, l).join(l, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
        y = rows.toxic.to_numpy()
        assert auc(rows.score.to_numpy(), y) > least and (rows.predicted == y).mean() > right
        assert rows.toxic[rows.predicted == 1].mean() > 0.95


def test_edges(spark):
    docs, labels = made_up(200)
    rows = docs + [(None, "nasty vile nasty vile " + prose(3, 40)), (900, None), (900, ""), (901, "nasty " * 30_000 + "vile"), (902, "\x00\n"), *[(2000 + (r[0] or 0), r[1]) for r in EDGE]]
    bad = [(None, 1), (900, None), (901, 7), (0, 0), (0, 1)]
    d, l = tables(spark, rows, labels + bad)
    got = tx.score(d, l).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    null = [r for r in got if r.doc_id is None]
    assert len(null) == 1 and not null[0].held_out and null[0].predicted == 1
    assert len({r.score for r in got if r.doc_id == 900}) == 1 and all(r.predicted == 0 for r in got if r.doc_id == 900)
    assert next(r for r in got if r.doc_id == 901).predicted == 1
    assert tx.score(d.limit(0), l).collect() == [] and tx.score(d, l).columns == ["doc_id", "held_out", "score", "predicted"]
    assert {r.score for r in tx.score(d, l.limit(0)).collect()} == {0.0}
    assert {r.score for r in tx.score(d, l.filter("toxic = 1")).collect()} == {1.0}


def test_label_model_finds_accuracies_and_correlated_voters():
    r = np.random.default_rng(1)
    y = r.random(6000) < 0.2
    right = [0.95, 0.9, 0.8, 0.7]
    votes = np.array([np.where(r.random(6000) < p, y, ~y) for p in right]).T * 2 - 1
    votes[r.random(votes.shape) < 0.2] = 0
    copy = np.where(r.random(6000) < 0.95, votes[:, 3], -votes[:, 3])  # says what the weakest voter says
    every = np.column_stack([votes, copy])
    guess = (votes.sum(1) > 0).astype(float)
    first = tx.LabelModel([[k] for k in range(5)]).fit(every, guess)
    groups = tx.correlated(every, first.posterior(every))
    assert [3, 4] in groups
    m = tx.LabelModel(groups).fit(every, guess)
    q = m.posterior(every)
    known = tx.LabelModel(groups).fit(every, y.astype(float), rounds=1).posterior(every)  # what the true classes would teach
    assert abs(m.share - 0.2) < 0.03 and ((q > 0.5) == y).mean() > ((known > 0.5) == y).mean() - 0.005
    for g, t in zip(m.groups, m.tables):
        if len(g) == 1:
            assert abs(t[1, 2] / (t[1, 0] + t[1, 2]) - right[g[0]]) < 0.04 and abs(t[1, 1] - 0.2) < 0.05


def test_logistic_and_tail():
    r = np.random.default_rng(2)
    x, t = r.normal(size=(300, 4)), r.random(300)
    w = tx.logistic(x, t)
    z = np.column_stack([x, np.ones(300)])
    gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - t) + np.array([1, 1, 1, 1, 1e-6]) * tx.RIDGE * w
    assert np.abs(gradient).max() < 1e-3
    for s, mu in ((0, 0.5), (1, 0.02), (3, 1.7), (7, 2.0)):
        want = 1 - sum(math.exp(-mu) * mu**k / math.factorial(k) for k in range(s))
        assert abs(tx.poisson_tail(np.array([s]), np.array([mu]))[0] - want) < 1e-12
