import random

import numpy as np
import pytest
from helpers import EDGE, frame

from gridloom.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    path = pieces.default_model()
    return sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary.load(path)


TEXTS = [t for _, t, *_ in EDGE if t] + ["  two  spaces ", "\n\n a\n", "naïve café ☃ \t x", "a" * 300, "hello world, hello worlds"]


def test_equals_the_library(model):
    sp, v = model
    ids, exact = pieces.encode_texts(TEXTS, pieces.Memory(v))
    assert ids.to_pylist() == [sp.encode(t) for t in TEXTS]
    assert exact == [t is None or pieces.decode_ids(i, v) == t.replace(pieces.MARK, " ") for i, t in zip(ids.to_pylist(), TEXTS, strict=True)]


def test_equals_the_library_on_the_table(spark, sf, model):
    sp, _ = model
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    for r in docs.collect():
        assert list(got[r.doc_id].ids) == sp.encode(r.text) and got[r.doc_id].exact


def test_edges_round_trip(spark):
    rows = [*EDGE, (60, "a▁b"), (61, " "), (62, "▁")]
    got = pieces.round_trip(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    assert [r.n_pieces for r in got if r.doc_id == 2] == [0] and [r.ids for r in got if r.doc_id == 1] == [None]
    assert pieces.round_trip(frame(spark, rows).limit(0)).count() == 0


def test_unigram_walk_matches_brute_force():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(200)})
    toy = {p: (i, -r.uniform(1, 9)) for i, p in enumerate(sorted({w[: r.randrange(1, 4)] for w in words} | set("abc")))}
    v = pieces.Vocabulary(toy, "unigram", [], -1)

    def best(w):
        if not w:
            return 0.0, []
        return max(((toy[w[:n]][1] + s, [toy[w[:n]][0], *rest]) for n in range(1, len(w) + 1) if w[:n] in toy for s, rest in [best(w[n:])]), key=lambda x: x[0])

    for w, (ids, spelled) in zip(words, pieces.walk(words, v), strict=True):
        ids = np.frombuffer(ids, np.int32)
        assert spelled.decode() == w
        score = {i: s for i, s in toy.values()}
        assert abs(sum(score[i] for i in ids) - best(w)[0]) < 1e-9


def test_words_that_decoding_loses_are_reported():
    toy = {pieces.MARK: (0, -1.0), "a": (1, -1.5)}
    v = pieces.Vocabulary(toy, "unigram", [], 2)  # no bytes to fall back on: other characters are lost
    ids, exact = pieces.encode_texts(["a a", "a b", None, ""], pieces.Memory(v))
    assert exact == [True, False, True, True] and ids.to_pylist()[1] == [0, 1, 0, 2]


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 5)
    v = pieces.Vocabulary.load(pieces.default_model())
    small, large = pieces.Memory(v), pieces.Memory(v)
    texts = [" ".join(f"w{i + k}" for k in range(4)) for i in range(30)]
    got = [i for t in texts for i in pieces.encode_texts([t], small)[0].to_pylist()]
    monkeypatch.setattr(pieces, "REMEMBER", 10**6)
    assert got == pieces.encode_texts(texts, large)[0].to_pylist()


def test_very_long_words():
    import sentencepiece

    path = pieces.default_model()
    v, sp = pieces.Vocabulary.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["ab" * 4000, "x" * 3000 + "é" * 50, "a" * 2999]
    assert pieces.encode_texts(texts, pieces.Memory(v))[0].to_pylist() == [sp.encode(t) for t in texts]


def test_long_text_without_spaces_takes_memory_in_proportion(spark):
    """A million characters without a space: a few hundred MB at most, and the library's ids on a part of it."""
    import random
    import tracemalloc

    v = pieces.Vocabulary.load(pieces.default_model())
    r = random.Random(1)
    word = "▁" + "".join(chr(r.randrange(0x4E00, 0x9000)) if r.random() < 0.5 else r.choice("abcdefgh") for _ in range(1_000_000))
    pieces.walk([word[:1000]], v)
    tracemalloc.start()
    (ids, spelled), = pieces.walk([word], v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spelled == word.encode() and peak < 500e6
    import sentencepiece

    part = word[1:4001]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert list(pieces.array("i", pieces.walk(["▁" + part], v)[0][0])) == sp.encode(part)
