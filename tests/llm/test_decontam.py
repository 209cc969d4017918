import random
import re

from helpers import EDGE, frame, prose, words

from gridloom.llm import decontam


def plain(text):
    return words("".join(c for c in (text or "").lower() if c.isalnum() or c in " \t\n\x0b\x0c\r"))


def brute(docs, items):
    """Pairs with a passage of which 80 of 100 words agree place by place, tried at every place; items under 5 words verbatim."""
    out = set()
    for d, t in docs:
        w = plain(t)
        for i, b in items:
            b = plain(b)
            v = min(len(b), 20)
            least = 100 if v < 5 else 80
            if v and any(
                100 * sum(x == y for x, y in zip(w[max(p, 0) : p + v], b[s + max(-p, 0) : s + v], strict=False)) >= least * v
                for s in range(len(b) - v + 1)
                for p in range(1 - v, len(w))
                if p + v > 0
            ):
                out.add((d, i))
    return out


def test_finds_exact_and_substituted_passages(spark):
    items = [(i, prose(300 + i, n)) for i, n in enumerate((40, 25, 13, 7, 3))] + [(5, None), (6, ""), (None, prose(320, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    r = random.Random(1)

    def inside(text, changes):
        w = text.upper().replace(" ", ", ").split()
        for k in r.sample(range(len(w)), changes):
            w[k] = "changed"
        return f"{prose(400, 30)} {' '.join(w)}\n{prose(401, 30)}"

    docs = [(d, t) for d, t, *_ in EDGE] + [
        (50, inside(items[0][1], 0)), (51, inside(items[0][1], 3)), (52, inside(items[1][1], 2)), (53, inside(items[2][1], 0)),
        (54, inside(items[3][1], 0)), (55, inside(items[4][1], 0)), (56, " ".join(items[0][1].split()[:10]) + " " + prose(402, 50)),
        (57, items[1][1]), (57, items[1][1]), (58, inside(items[7][1], 0)), (59, inside(items[0][1], 25)),
    ]
    got = decontam.report(frame(spark, docs, extra=True), bench).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in got) == sorted(map(str, brute(docs, items)))
    hit = {r.doc_id for r in got}
    assert hit == {50, 51, 52, 53, 54, 55, 57, 58}
    hit.remove(55)  # an item of three words alone drops no document
    out = decontam.keep(frame(spark, docs, extra=True), bench)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(d) for d, _ in docs if d not in hit)
    assert decontam.report(frame(spark, docs).limit(0), bench).count() == 0
    assert decontam.report(frame(spark, docs), bench.limit(0)).count() == 0


def test_real_table(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.report(docs, bench).collect()}
    flat = [(i.item_id, " " + " ".join(plain(i.text)) + " ") for i in bench.collect()]
    whole = {(d.doc_id, i) for d in docs.collect() for t in [" " + " ".join(plain(d.text)) + " "] for i, b in flat if b in t}
    assert whole <= got


def test_no_allowed_change_escapes_the_masks():
    from itertools import combinations

    from gridloom.llm import oracles

    for n in range(5, 24):
        v = min(n, decontam.PASSAGE)
        names = [f"two{m}" for m in decontam.MASKS] if n >= decontam.PASSAGE else ["run", "gap"]
        reads = [oracles._reads(m) for m in names]
        for gone in combinations(range(v), v - -(-decontam.SHARE * v // 100)):
            assert any(not {p + k for k in at} & set(gone) for span, at in reads for p in range(v - span + 1)), (n, gone)


def test_repeated_runs_short_items_and_every_change(spark, monkeypatch):
    from itertools import combinations

    w = [f"v{k}" for k in range(40)]
    phrase = w[:12]
    items = [(1, " ".join([*phrase, *w[12:20], *phrase, *w[20:28]])), (2, "four words stand here"), (3, " ".join(w[28:33])), (4, " ".join(w[30:40]))]
    docs = [(1, " ".join(["x", *phrase[4:], *w[20:28], "y"])), (2, "so four words stand here again"), (3, "four words stand not here"), (4, " ".join([*phrase, *w[12:20]][4:]))]
    for c, n in ((3, 1), (4, 2)):  # every pattern of tolerated changes, and some beyond
        text = items[c - 1][1].split()
        for k, gone in enumerate([*combinations(range(len(text)), n), *list(combinations(range(len(text)), n + 1))[:5]]):
            docs.append((1000 * c + k, "before " + " ".join("changed" if j in gone else x for j, x in enumerate(text)) + " after"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(1, 1), (2, 2), (4, 1)} <= want and (3, 2) not in want
    for most in (decontam.BROADCAST_SEEDS, 0):  # with the broadcast and without
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", most)
        assert {(r.doc_id, r.item_id) for r in decontam.report(frame(spark, docs), bench).collect()} == want


def test_least_length_of_items_that_remove(spark):
    docs = frame(spark, [(1, prose(1, 60) + " zebra quagga okapi " + prose(2, 60)), (2, prose(3, 80))])
    items = spark.createDataFrame([(7, "Zebra quagga okapi")], "item_id long, text string")
    assert [r.doc_id for r in decontam.report(docs, items).collect()] == [1]
    assert sorted(r.doc_id for r in decontam.keep(docs, items).collect()) == [1, 2]
    assert [r.doc_id for r in decontam.keep(docs, items, shortest=1).collect()] == [2]


def test_copies_of_items_and_blocks_of_seeds(spark, monkeypatch):
    w = [f"v{k}" for k in range(400)]
    texts = [" ".join(w[30 * k : 30 * k + 25 + k]) for k in range(5)] + [" ".join(w[200 : 200 + n]) for n in (3, 7, 150)]
    items = [(100 * c + k, t) for c in range(40) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0]), (0, texts[1])]
    docs = [(k, f"before {' '.join(t.split()[: 20 + 3 * k])} after") for k, t in enumerate(texts)] + [(8, " ".join(w[195:360])), (9, "nothing of them")]
    written, plans = [], []

    def watch(df, real=decontam.materialise):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        written.append(real(df))
        return written[-1]

    monkeypatch.setattr(decontam, "materialise", watch)
    bench, want = spark.createDataFrame(items, "item_id long, text string"), brute(docs, items)
    assert len(want) > 300
    rows = []
    for most in (decontam.BROADCAST_SEEDS, 400, 0):  # one block, some, one for each text and PLACES places
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", most)
        monkeypatch.setattr(decontam, "PLACES", 50, raising=False)
        out = decontam.report(frame(spark, docs), bench)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        rows.append(sorted(str(tuple(r)) for r in out.collect()))
        assert {(r.doc_id, r.item_id) for r in out.collect()} == want
    assert rows[0] == rows[1] == rows[2]
    once = sum(len(decontam.MASKS) * len(t.split()) for t in texts)
    assert all(x.count() <= once for x in written if "seed" in x.columns)  # copies of an item are searched for once
    assert not any("hashpartitioning(seed" in p for p in plans)  # no row for every place of the documents is shuffled
