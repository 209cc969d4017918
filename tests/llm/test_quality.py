from collections import Counter

from helpers import EDGE, frame, prose, words

from gridloom.llm import quality


def brute(text):
    w = words(text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    hit = {j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_match_brute_force(spark):
    got = quality.judge(frame(spark, EDGE, extra=True)).collect()
    want = sorted(map(str, [(d, *brute(t), (b := brute(t))[0] < 50 or 100 * b[4] > 50 * b[0]) for d, t, *_ in EDGE]))
    assert sorted(str(tuple(r)[:7]) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_real_tables_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:6] for r in quality.judge(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_adaptive_fences_reject_outliers_and_keep_the_rest(spark):
    rows = [(i, prose(i, 100)) for i in range(60)] + [(100 + i, prose(i, 100).replace(" ", " ### ")) for i in range(5)]
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(5))
    # a source where symbols are usual keeps them
    rows = [(i, prose(i, 100).replace(" ", " ### "), "en", "code") for i in range(30)]
    assert all(r.kept for r in quality.judge(frame(spark, rows)).collect())


def test_sketches_merge_and_bound_the_error(spark):
    docs = frame(spark, [(i, prose(i, 60 + i)) for i in range(80)])
    m = quality.measures(docs)
    a, b = (quality.sketch(m.filter(f"doc_id % 2 = {k}")) for k in (0, 1))
    whole = sorted(map(tuple, quality.sketch(m).collect()))
    assert sorted(map(tuple, quality.merge(a, b).collect())) == whole
    for v in (0, 1, 63, 64, 65, 127, 128, 1000, 99_999, 2**40 + 12345):
        low = spark.sql(f"select {quality.low_end('b')} x from (select {quality.bucket(f'{v}L')} b)").head().x
        assert low <= v <= low * 33 / 32 + 1


def test_keep_returns_rows_of_documents(spark):
    docs = frame(spark, EDGE, extra=True)
    out = quality.keep(docs)
    assert out.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in quality.judge(docs).collect() if r.kept)
    assert sorted(str(r.doc_id) for r in out.collect()) == kept
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep(docs.limit(0)).count() == 0


def test_pooled_fences_reject_junk_of_rare_and_mixed_sources(spark):
    junk = lambda i: prose(i, 100).replace(" ", " ### ")
    rows = [(i, prose(i, 100), "en", "plain") for i in range(240)]
    rows += [(250, junk(250), "en", "rare"), (251, junk(251), "xx", "plain"), (252, prose(252, 100), "en", "rare"), (253, junk(253), None, None)]
    rows += [(300 + i, prose(i, 100) if i < 30 else junk(i), "en", "mixed") for i in range(50)]
    rows += [(400 + i, junk(400 + i), "de", "code") for i in range(50)]  # uniform: its own norm
    docs = frame(spark, rows)
    want = [r[0] for r in rows if r[0] not in (250, 251, 253) and not 330 <= r[0] < 400]
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == want
    got = {r.doc_id for r in quality.judge(docs, quality.pooled_fences).collect() if r.kept}
    assert sorted(got) == want
