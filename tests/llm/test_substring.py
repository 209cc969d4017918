import hashlib
from collections import Counter

from helpers import EDGE, frame, prose, words

from gridloom.llm import substring


def brute(rows, width=35):
    n = Counter(tuple(w[i : i + width]) for _, t in rows for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + j for i in range(len(w) - width + 1) if n[tuple(w[i : i + width])] > 1 for j in range(width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append(str((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())))
    return sorted(out)


def test_matches_brute_force(spark):
    a, b, c = prose(50, 35), prose(51, 34), prose(52, 60)
    rows = [(d, t) for d, t, *_ in EDGE] + [
        (30, f"{prose(60, 7)} {a} {prose(61, 9)}"), (31, f"{prose(62, 20)}\n{a}\t{prose(63, 1)}"),
        (32, f"{b} x"), (33, f"y {b}"), (34, f"{c} {prose(64, 40)} {c}"), (35, f"{prose(65, 3)} {c}"),
        (36, c), (37, c + " end"), (36, "another text of the same id " + prose(66, 50)),
    ]
    got = substring.digest(frame(spark, rows, extra=True)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert substring.digest(frame(spark, rows).limit(0)).count() == 0


def test_rows_without_id_are_documents_of_their_own(spark):
    a = prose(90, 36)
    rows = [(None, f"{a} {prose(91 + i, 40)}") for i in range(20)] + [(None, prose(200, 60))] * 3 + [(None, None), (None, ""), (-(2**63), f"{prose(201, 5)} {a}")]
    docs = frame(spark, rows)
    keyed = docs.selectExpr("xxhash64(text) id", "text").filter("text is not null").limit(1).first()
    rows.append((keyed.id, prose(202, 50) + " " + prose(200, 40)))  # an id that is the hash of another row's text
    got = substring.digest(frame(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_real_table_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(str(tuple(r)) for r in substring.digest(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_keep_returns_rows_of_documents(spark):
    p = prose(70, 40)
    docs = frame(spark, [(1, f"a  b\n{p}\nc d"), (2, f"{p} z"), (3, None)], extra=True)
    got = {r.doc_id: r for r in substring.keep(docs).collect()}
    assert substring.keep(docs).columns == docs.columns
    assert got[1].text == "a  b\nc d" and got[2].text == "z" and got[3].text is None
    assert got[1].n_chars == 8 and got[1].kept == "x"


def test_cover():
    assert substring.is_cover(substring.COVER, substring.PERIOD)
    assert not substring.is_cover((0, 1), 21)
