import random

import pytest
from helpers import EDGE, frame

from gridloom.llm import tokens

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def c():
    return tokens.counter(tokens.default_vocabulary())


BITS = ["a", "word", " ", "  ", "\n", "\t ", "'s", "'", "12", "é", "漢", "!?", " x", "the", "\n\n  ", "ll", "\U0001f600"]


def test_edits_match_counting_anew(c):
    r = random.Random(11)
    for n in (0, 1, 5, 60, 900):
        for _ in range(25):
            t = tokens.Tree("".join(r.choice(BITS) for _ in range(n)), c)
            for _ in range(8):
                a = r.randrange(len(t.text) + 1)
                z = min(len(t.text), a + r.choice((0, 0, 1, 2, 7, 400)))
                t.edit(a, z, "".join(r.choice(BITS) for _ in range(r.choice((0, 1, 2, 6, 300)))))
                assert t.total == len(c.encoding.encode_ordinary(t.text))
                pieces = c.find.findall(t.text)
                assert [x for b in t.blocks for x in b] == [(len(p), c.count(p)) for p in pieces]


def test_an_edit_encodes_its_surroundings_only(c):
    t = tokens.Tree("plain words in a row " * 5000, c)
    t.edit(50_000, 50_005, "changed")
    assert t.cut_anew < 12 and t.total == len(c.encoding.encode_ordinary(t.text))


def test_table(spark, sf, c):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in tokens.count(docs).collect()}
    for r in docs.collect():
        edited = r.text
        for s, e, new in sorted(tokens.redactions(r.text), reverse=True):
            edited = edited[:s] + new + edited[e:]
        assert got[r.doc_id].n_tokens == len(c.encoding.encode_ordinary(r.text))
        assert got[r.doc_id].n_tokens_edited == len(c.encoding.encode_ordinary(edited))
    assert any(r.n_edits for r in got.values())


def test_edges(spark, c):
    got = tokens.count(frame(spark, EDGE, extra=True)).collect()
    want = sorted(str((d, len(c.encoding.encode_ordinary(t or "")))) for d, t, *_ in EDGE)
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == want
    assert tokens.count(frame(spark, EDGE).limit(0)).count() == 0
    df = frame(spark, [(1, "hello world")]).selectExpr("*", "array(struct(0 as s, 5 as e, 'bye now' as t)) as own")
    assert tokens.count(df, "own").head().n_tokens_edited == len(c.encoding.encode_ordinary("bye now world"))
    with pytest.raises(ValueError):
        tokens.counted("abc", [(0, 2, ""), (1, 3, "")], c)
