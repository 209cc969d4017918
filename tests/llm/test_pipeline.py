import pytest
from helpers import frame, prose
from test_decontam import brute as leaks
from test_minhash import brute as groups
from test_minhash import edited
from test_quality import brute as measures
from test_substring import words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
sentencepiece = pytest.importorskip("sentencepiece")


def cut(rows, width=35):
    from collections import Counter

    n = Counter(tuple(w[i : i + width]) for _, t in rows for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + j for i in range(len(w) - width + 1) if n[tuple(w[i : i + width])] > 1 for j in range(width)}
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    passage, item = prose(900, 50), prose(901, 40)
    rows = [(i, prose(i, 150)) for i in range(30)]
    rows += [(40, rows[3][1]), (41, edited(rows[4][1], 3, 1)), (42, "too short"), (43, "spam spam " * 60)]
    rows += [(44, f"{prose(44, 70)} {passage} {prose(45, 70)}"), (45, f"{prose(46, 90)} {passage}"), (46, f"{prose(47, 80)} {item} {prose(48, 80)}")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, item), (2, prose(902, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    want = [(d, t) for d, t in rows if (m := measures(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]]  # fences pass all prose
    least = groups(want)
    want = cut([(d, t) for d, t in want if least[d] == d])
    bad = {d for d, _ in leaks(want, items)}
    want = {d: t for d, t in want if d not in bad}
    assert got.keys() == want.keys() and not {40, 41, 42, 43, 46} & got.keys()
    from gridloom.llm import pieces

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for d, t in want.items():
        assert got[d].exact and sp.decode(list(got[d].ids)).split() == t.split()
        assert got[d].n_pieces == len(got[d].ids)


def test_stages_are_in_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "minhash near-dedup", "substring dedup", "benchmark decontamination", "sentencepiece"]
