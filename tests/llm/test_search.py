import math
import re

from helpers import EDGE, frame, prose

from gridloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    ts = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in ts), sum(len(t) for _, t in ts)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        df = {w: sum(w in t for _, t in ts) for w in wanted}
        scored = []
        for d, t in ts:
            if t:
                m = 100 - 90 + (90 * len(t) * n_docs) // total
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 8 * m))
                    for w in wanted if w in t
                )
                if score > 0:
                    scored.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


def got(spark, docs, items, **kw):
    d = frame(spark, docs, extra=True)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "'x' as term", "0 as n")
    return sorted(str(tuple(r)) for r in search.rank(d, i, **kw).collect())


DOCS = EDGE + [
    (20, "The cat-sat on_the MAT"), (21, "the the the\x00cat"), (22, "cat"), (22, "cat"), (22, "cat dog"), (None, "cat"), (None, None),
    (23, "ÉCOLE école Ünïcode 漢字 漢字kanji"), (24, "cats concat"), (-5, "cat"), (25, "dog " * 5000 + "cat"),
]
ITEMS = [
    (1, "Cat, on the mat!"), (2, "ÉCOLE 漢字"), (3, None), (4, ""), (5, "zzz unseen"), (6, "alpha1 cat"), (6, "dog dog"), (None, "the dog"),
    (7, prose(1, 120)), (8, prose(2, 400)), (9, "école"),
]


def test_matches_brute_force_with_ties_nulls_and_repeats(spark):
    assert got(spark, DOCS, ITEMS) == brute([r[:2] for r in DOCS], ITEMS)
    many = [(k, f"cat {'dog ' * (k % 3)}") for k in range(200)]
    assert got(spark, many, ITEMS) == brute(many, ITEMS)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 5)
    monkeypatch.setattr(search, "CHUNK_POSTINGS", 3)
    monkeypatch.setattr(search, "FAN_IN", 1)
    assert got(spark, DOCS, ITEMS, top=3) == brute([r[:2] for r in DOCS], ITEMS, 3)


def test_whole_tables_by_brute_force(spark, sf):
    d, i = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()])
    assert sorted(str(tuple(r)) for r in search.rank(d, i).collect()) == want


def test_empty_tables(spark):
    d = frame(spark, DOCS)
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.filter("text is null"), i)):
        assert search.rank(a, b).collect() == []
        assert search.rank(a, b).columns == ["item_id", "rank", "doc_id", "score"]
