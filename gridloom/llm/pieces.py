"""SentencePiece encoding and decoding over a trie of distinct words (operator 8).

A text is marked (spaces become the mark, one mark in front) and cut into marked words: a run of marks and
what follows it up to the next mark or line feed, which no piece crosses.  The distinct marked words of a
batch are sorted, which lays out their trie, and walked depth-first: each step adds one character and
computes the forward table of the longer prefix from those of its prefixes, so words that begin alike share
all forward scores of their common prefix.  Each prefix also carries its state in an automaton of all pieces,
which knows the pieces that end there, so these look-ups are shared too.  Memory is one path of the trie and
one batch's distinct words.

Two kinds of model, one walk:

* unigram: the classic Viterbi recursion; a prefix's score is the best sum of piece scores;
* bpe (merge order): the same forward table, but a piece may follow the last piece of a shorter prefix only
  if the two, merged anew from characters, come out as that very pair.  Exactly one path satisfies this for
  every prefix, and it is what repeated best-first merging gives; scores of such a model are merge ranks,
  and the best sum of ranks would be a different, wrong segmentation.

Characters without a piece are encoded as bytes (a cut for every word, as no piece holds one).

Decoding joins the pieces, turns byte pieces into UTF-8 and marks into spaces, and drops the front mark.
It gives back every text exactly, but for a literal mark character (U+2581), which reads as a space.

Defined results: null gives null ids; the empty text gives no ids; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored by :func:`encode` callers that select them.
The vocabulary file's path is a parameter; executors read it where the library package that holds it is
installed.
"""

from __future__ import annotations

import gc
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Distinct words remembered from batch to batch in a worker, in two generations; when the younger is full the elder goes.
REMEMBER = 360_000
#: Pairs of pieces remembered as following each other or not.
PAIRS = 300_000
#: Texts encoded at a time.
STRIDE = 600


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary:
    """Pieces, scores and kind of a model."""

    def __init__(self, pieces: dict[str, tuple[int, float]], kind: str, byte_ids: list[int], unk: int):
        self.pieces, self.kind, self.byte_ids, self.unk = pieces, kind, byte_ids, unk
        self.text = {i: p for p, (i, _) in pieces.items()}
        spelling = {i: p.encode("utf-8", "surrogatepass") for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.spelled = defaultdict(bytes, spelling).__getitem__
        self._automaton()
        self.n_pairs = 0

    def _automaton(self) -> None:
        """States of the pieces' trie: steps by character, the longest proper suffix state, the pieces that end there.

        A piece is (id, length, score, id as bytes, spelling, which pieces it may follow as far as known); those of a
        state are listed longest first.
        """
        self.steps: list[dict[str, int]] = [{}]
        own: list[tuple | None] = [None]
        for p, (i, score) in self.pieces.items():
            at = 0
            for c in p:
                to = self.steps[at].get(c)
                if to is None:
                    to = self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    own.append(None)
                at = to
            own[at] = (i, len(p), score, array("i", [i]).tobytes(), self.spelled(i), {})
        self.suffix, self.ends, self.follow = [0] * len(own), [()] * len(own), [p[5] for p in own if p]
        level = [(0, c, s) for c, s in self.steps[0].items()]
        while level:  # by length, so that suffixes come first
            below = []
            for before, c, s in level:
                to = self.suffix[before]
                while before and c not in self.steps[to] and to:
                    to = self.suffix[to]
                self.suffix[s] = self.steps[to].get(c, 0) if before else 0
                rest = self.ends[self.suffix[s]]
                self.ends[s] = (own[s], *rest) if own[s] else rest
                below += [(s, d, x) for d, x in self.steps[s].items()]
            level = below

    def step(self, state: int, c: str) -> int:
        """The state after one more character; it joins the steps, which it doesn't change the sense of."""
        at = state
        while at and c not in self.steps[at]:
            at = self.suffix[at]
        to = self.steps[state][c] = self.steps[at].get(c, 0)
        return to

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.vocab_size())
        plain = [i for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}
        at = {sp.id_to_piece(i): i for i in n if sp.is_byte(i)}
        byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)] if len(at) == 256 else []
        # in a merge-order model scores are 0, -1, -2, ...: whole numbers
        kind = "bpe" if all(float(s).is_integer() for _, s in pieces.values()) else "unigram"
        return cls(pieces, kind, byte_ids, sp.unk_id())

    def merged(self, text: str) -> list[str]:
        """Best-first merging from characters (leftmost of equals); for short strings and as a check."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max(
                ((self.pieces[a + b][1], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.pieces),
                default=(None, 0),
            )
            if score is None:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def follows(self, a: int, p: tuple) -> bool:
        """Whether merging piece a and piece p from characters gives the pair again; remembered with p."""
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            self.n_pairs = 1
            for f in self.follow:
                f.clear()
        x, y = self.text[a], self.text[p[0]]
        ok = p[5][a] = self.merged(x + y) == [x, y]
        return ok

    def raw(self, c: str) -> bytes:
        return array("i", [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk]).tobytes()


def walk(words: list[str], v: Vocabulary) -> list[tuple[bytes, bytes]]:
    """(ids as 32-bit bytes, what they spell) of each of the sorted, distinct words, by one depth-first pass over their trie."""
    out: list[tuple[bytes, bytes]] = []
    # forward table by prefix length: state, score, last piece (None for a lone character); ids are written once, at a word's end
    state: list[int] = [0]
    score: list[float] = [0.0]
    back: list[tuple | None] = [None]
    before = ""
    known, ends, unigram = v.steps, v.ends, v.kind == "unigram"
    for w in words:
        n = 0
        for a, b in zip(before, w, strict=False):
            if a != b:
                break
            n += 1
        end = n + 1
        del state[end:], back[end:], score[end:]
        s = state[n]
        for c in w[n:] if n else w:
            to = known[s].get(c)
            s = v.step(s, c) if to is None else to
            how = None
            if unigram:
                best = -math.inf
                for p in ends[s]:
                    x = score[end - p[1]] + p[2]
                    if x > best or x == best and p[1] < how[1]:
                        best, how = x, p
                score.append(best if how else score[end - 1] - 1e6)
            else:
                for p in ends[s]:  # the longest first: a shorter one that also follows can't be on the path
                    last = back[end - p[1]]
                    if last is not None:
                        ok = p[5].get(last[0])
                        if not (v.follows(last[0], p) if ok is None else ok):
                            continue
                    how = p
                    break
            state.append(s)
            back.append(how)
            end += 1
        before = w
        ids, spell, at = [], [], len(w)
        while at:
            how = back[at]
            if how:
                ids.append(how[3])
                spell.append(how[4])
                at -= how[1]
            else:  # where no piece ends, the character stands alone, as bytes
                at -= 1
                raw = v.raw(w[at])
                ids.append(raw)
                spell.append(b"".join(map(v.spelled, array("i", raw))))
        out.append((b"".join(ids[::-1]), b"".join(spell[::-1])))
    return out


def marked(text: str) -> str:
    return (MARK + text.replace(" ", MARK)) if text else ""


class Memory(dict):
    """Ids of the words seen before, in two generations, and those words that decoding does not give back."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.lost, self.elder = v, set(), {}

    def learn(self, units: set[str]) -> None:
        new = units - self.keys()
        if len(self) + len(new) > REMEMBER // 2:
            self.elder = dict(self)
            self.clear()
            self.lost &= units | self.elder.keys()
            new = units
        again = new & self.elder.keys()
        self.update(zip(again, map(self.elder.__getitem__, again), strict=True))
        new = sorted(new - again)
        for w, (ids, spelled) in zip(new, walk(new, self.v), strict=True):
            self[w] = ids
            if spelled != w.encode("utf-8", "surrogatepass"):
                self.lost.add(w)


def encode_texts(texts: list[str | None], memory: Memory) -> tuple[pa.ListArray, list[bool]]:
    """Ids of each text, and whether decoding them gives it back: that is so if it is for each word, decoded once."""
    cut = [None if t is None else UNIT.findall(marked(t)) for t in texts]
    memory.learn(set().union(*filter(None, cut)))
    look = memory.__getitem__
    ids = [b"" if c is None else b"".join(map(look, c)) for c in cut]
    exact = [not (memory.lost and c and not memory.lost.isdisjoint(c)) for c in cut]
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(ids), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([c is None for c in cut])), exact


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """The text of ids; bytes that are not UTF-8 become replacement characters, unknown ids nothing."""
    text = b"".join(map(v.spelled, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def _loaded(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def encode(df: DataFrame, model: str | None = None, column: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of a text column in array column ``out``."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(_loaded(path))
        for b in batches:
            for at in range(0, len(b), STRIDE):
                part = b.slice(at, STRIDE)
                ids, _ = encode_texts(part.column(0).to_pylist(), memory)
                yield pa.RecordBatch.from_arrays([ids, part.column(1)], names=["ids", "row"])

    # the other columns travel in one struct, so none can clash
    d = df.select(F.col(f"`{column}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    r = d.mapInArrow(run, StructType([StructField("ids", ArrayType(IntegerType())), d.schema["row"]]))
    return r.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out], F.col("ids").alias(out))


def decode(df: DataFrame, model: str | None = None, column: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of an id column in string column ``out``; null ids give null."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(path)
        for b in batches:
            text = [None if i is None else decode_ids(i, v) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), b.column(1)], names=["text", "row"])

    d = df.select(F.col(f"`{column}`").cast("array<int>").alias("ids"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    r = d.mapInArrow(run, StructType([StructField("text", StringType()), d.schema["row"]]))
    return r.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out], F.col("text").alias(out))


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, n_pieces and whether decoding gives the text back (marks read as spaces), in one pass."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(_loaded(path))
        gc.disable()  # millions of small objects and no cycles: collections would only look at them again and again
        for b in batches:
            for at in range(0, len(b), STRIDE):
                part = b.slice(at, STRIDE)
                texts = part.column(1).to_pylist()
                ids, exact = encode_texts(texts, memory)
                n = pa.array([None if t is None else z - a for t, a, z in zip(texts, ids.offsets.to_pylist(), ids.offsets.to_pylist()[1:], strict=False)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, n, pa.array(exact, pa.bool_())], names=["doc_id", "ids", "n_pieces", "exact"])
        gc.enable()

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, exact boolean")
