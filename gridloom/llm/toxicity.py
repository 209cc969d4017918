"""Toxicity by weak supervision (operator 12): many weak voters, a label model of them, a linear classifier on its posterior.

1. **Fit rows.**  Labelled documents whose ``crc32(doc_id) mod 5`` is not 0, ``FIT_ROWS`` of them at most on average (chosen by a hash of
   doc_id), one text for each doc_id and one document for each group of near copies (the least hash of its five-word shingles), so that a group
   of copies can't make its own words look like signs.
2. **Lexicons.**  Words and beginnings of words that stand in toxic fit rows significantly more often than in clean ones, counted
   in the partitions and summed by one group-by.  Terms that say the same as a longer one are dropped.
3. **Voters.**  The terms are dealt into lexicons of like strength; each votes toxic if the text has more of its terms than chance explains, clean if it
   has none, else not at all.  Pattern voters look for shouting, runs of marks and the like.
4. **Label model.**  A latent class explains all votes; expectation maximisation estimates how often each voter says what under each class,
   the given label being one more voter whose errors are estimated too.  Voters whose votes still agree under a class are correlated
   and are modelled by their joint votes.
5. **Classifier.**  Logistic regression on the excess of each term over chance, and on the votes, with the posterior as its target.

Steps 3 to 5 fit ``FIT_ROWS`` rows and ``TERMS`` terms at most, on the driver; every document is then scored where it lies, from its
whole text alone.

Defined results: a null or empty text has no words and gets the score of a text without signs; rows that repeat a doc_id are scored each, and the text
with the least hash stands for it in the fit; of several labels of a doc_id the largest counts; labels other than 0 and 1, and null ids, are ignored;
a row without doc_id is not held out; without both classes among the fit rows every score is the share of toxic ones (0 without labels); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import materialise, text_of, words_of

#: Labelled documents that are fitted on, on average; fewer if there are fewer.
FIT_ROWS = 12_000
#: One part of HELD_OUT by the hash of doc_id is never learnt from.
HELD_OUT = 5
#: Terms kept, the documents and the normal deviate that a term needs, and the lengths of beginnings of words.
TERMS, LEAST_DOCS, LEAST_Z, BEGINNINGS = 400, 3, 4.0, (3, 4, 5, 6, 7)
#: A term is judged by the documents that hold it at least so often, whichever tells most.
OFTEN = (1, 2, 4)
#: Lexicons: so many levels of strength, each dealt into so many.
LEVELS, PER_LEVEL = 4, 2
#: Chance of the hits of a lexicon below which it votes toxic.
CHANCE = 0.02
#: Correlation of two voters within a class from which they are modelled together, and most voters modelled together.
CORRELATED, TOGETHER = 0.2, 3
#: Weight of the ridge of the classifier.
RIDGE = 1.0

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = (
    re.compile(r"[!?]{2,}"),
    re.compile(r"[#*$%&@]{2,}"),
    re.compile(r"\b[^\W\d_a-z]{3,}\b"),
    re.compile(r"\b(\w+)(?:\W+\1\b){2,}"),
    re.compile(r"\b(?:you|your|du|dein|tu|ton|vous)\b", re.I),
)
#: Votes of patterns, at so many hits a thousand words.
PATTERN_RATE = 30


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def count_candidates(text: str) -> Counter:
    """Each word of a text (with a mark after it) and each beginning of a word, with its number."""
    out: Counter = Counter()
    for w, n in Counter(words(text)).items():
        out[w + " "] += n
        for k in BEGINNINGS:
            if len(w) >= k:
                out[w[:k]] += n
    return out


@dataclass
class Lexicon:
    """Terms (a beginning of a word, or a whole word and a space), their chance per word and their lexicons."""

    terms: list[str]
    rate: np.ndarray
    group: np.ndarray

    @property
    def n_voters(self) -> int:
        return LEVELS * PER_LEVEL + len(_PATTERNS)

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            a.add_word(" " + t, i)
        if self.terms:
            a.make_automaton()
        return a if self.terms else None

    def read(self, text: str, automaton: ahocorasick.Automaton | None) -> tuple[int, list[int], list[int], list[int]]:
        """Number of words; the terms in the text and their counts; hits of the patterns."""
        w = words(text)
        hits = Counter(i for _, i in automaton.iter(f" {' '.join(w)} ")) if automaton and w else {}
        return len(w), list(hits), list(hits.values()), [sum(1 for _ in p.finditer(text)) for p in _PATTERNS]

    def matrices(self, rows: list[tuple[int, list[int], list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Excess of each term and votes (1 toxic, -1 clean, 0 none) of each voter, a row for each text."""
        n = np.array([r[0] for r in rows], float)[:, None]
        counts = np.zeros((len(rows), len(self.terms)))
        for k, r in enumerate(rows):
            counts[k, r[1]] = r[2]
        chance = n * self.rate
        excess = (counts - chance) / np.sqrt(chance + 0.5)
        votes = np.zeros((len(rows), self.n_voters))
        for g in range(LEVELS * PER_LEVEL):
            own = self.group == g
            if own.any():
                s, mu = counts[:, own].sum(1), chance[:, own].sum(1)
                votes[:, g] = np.where(s == 0, -1, np.where(poisson_tail(s, mu) < CHANCE, 1, 0))
        patterns = np.array([r[3] for r in rows], float).reshape(len(rows), -1)
        votes[:, LEVELS * PER_LEVEL :] = 1000 * patterns > PATTERN_RATE * np.maximum(n, 1)
        return np.sign(excess) * np.log1p(np.abs(excess)), votes


def poisson_tail(s: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """P(X >= s) of a Poisson variable, s cut at 40."""
    s = np.minimum(s, 40).astype(int)
    term, below = np.exp(-mu), np.zeros_like(mu)
    for k in range(int(s.max(initial=0))):
        below += np.where(k < s, term, 0)
        term = term * mu / (k + 1)
    return np.maximum(1 - below, 0)


def choose_terms(table: list[tuple], n_toxic: int, clean_words: int) -> Lexicon:
    """Lexicons from (term, toxic documents, clean documents, occurrences in clean ones), the most telling first."""
    kept, seen = [], set()
    for term, a, b, in_clean in table:
        rate = (in_clean + 0.5) / max(clean_words, 1)
        # a shorter beginning in the same documents says nothing new
        if not any((term.strip() + rest, a, b) in seen for rest in _extensions(term, seen, a, b)):
            kept.append((term, rate, a / n_toxic))
            seen.add((term.strip(), a, b))
        if len(kept) == TERMS:
            break
    lift = np.array([np.log(share / rate) for _, rate, share in kept])
    level = (np.argsort(np.argsort(-lift, kind="stable"), kind="stable") * LEVELS // max(len(kept), 1)) if kept else np.empty(0, int)
    group = level * PER_LEVEL + np.arange(len(kept)) % PER_LEVEL
    return Lexicon([t for t, _, _ in kept], np.array([r for _, r, _ in kept], float), group)


def _extensions(term: str, seen: set, a: int, b: int) -> list[str]:
    """What, put after a term, gives a term already seen in as many documents."""
    t = term.strip()
    return [s[len(t) :] for s, x, y in seen if (x, y) == (a, b) and s.startswith(t)]


class LabelModel:
    """Latent classes of votes: tables P(joint vote of a group of voters | class) and the share of toxic."""

    def __init__(self, groups: list[list[int]]):
        self.groups = groups

    def _codes(self, votes: np.ndarray) -> list[np.ndarray]:
        return [((votes[:, g] + 1) @ (3 ** np.arange(len(g)))).astype(int) for g in self.groups]

    def fit(self, votes: np.ndarray, toxic: np.ndarray, rounds: int = 100) -> LabelModel:
        """toxic: first guess of each row's chance to be toxic."""
        codes, q = self._codes(votes), toxic
        for _ in range(rounds):
            self.share = min(max(q.mean(), 1e-3), 1 - 1e-3)
            self.tables = []
            for g, c in zip(self.groups, codes):
                t = np.array([np.bincount(c, 1 - q, 3 ** len(g)), np.bincount(c, q, 3 ** len(g))])
                base = np.bincount(c, minlength=3 ** len(g)) / len(c)  # what both classes are drawn to
                self.tables.append((t + base + 1e-6) / (t.sum(1, keepdims=True) + 1 + 1e-6 * t.shape[1]))
            new = self.posterior(votes)
            moved, q = np.abs(new - q).max(), new
            if moved < 1e-6:
                break
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        s = np.full(len(votes), math.log(self.share / (1 - self.share)))
        for c, t in zip(self._codes(votes), self.tables):
            s += np.log(t[1, c] / t[0, c])
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def correlated(votes: np.ndarray, q: np.ndarray) -> list[list[int]]:
    """Voters in groups: those whose votes go together under a class share one, of TOGETHER voters at most, strongest pairs first."""
    k = votes.shape[1]
    strength = np.zeros((k, k))
    for w in (q, 1 - q):
        if w.sum() > 1:
            d = votes - (w @ votes) / w.sum()
            c = (d * w[:, None]).T @ d / w.sum()
            s = np.sqrt(np.maximum(np.diag(c), 1e-12))
            strength = np.maximum(strength, np.abs(c / np.outer(s, s)) * (np.outer(s, s) > 1e-3))
    group = list(range(k))
    for i, j in sorted(((i, j) for i in range(k) for j in range(i)), key=lambda p: -strength[p]):
        if strength[i, j] < CORRELATED:
            break
        both = [x for x in range(k) if group[x] in (group[i], group[j])]
        if group[i] != group[j] and len(both) <= TOGETHER:
            for x in both:
                group[x] = min(group[i], group[j])
    return [[x for x in range(k) if group[x] == g] for g in sorted(set(group))]


def label_posterior(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Chance that each fit row is toxic, from all voters and its label as one more voter."""
    every = np.column_stack([np.where(labels == 1, 1, -1), votes])
    guess = np.where(labels == 1, 0.95, 0.05)
    first = LabelModel([[k] for k in range(every.shape[1])]).fit(every, guess)
    groups = [[0]] + [[x + 1 for x in g] for g in correlated(votes, first.posterior(every))]
    return LabelModel(groups).fit(every, guess).posterior(every)  # anew, since correlated voters may have drawn the first one to themselves


def logistic(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft targets, the last one free of the ridge; Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1] - 1, RIDGE), 1e-6)
    w = np.zeros(x.shape[1])
    w[-1] = math.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w) + 0.5 * ridge @ (w * w)
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - target) + ridge * w)
        size = 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        now, before = loss(w), now
        if before - now < 1e-7 * max(1.0, abs(now)):
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None  # of excesses, votes and 1
    constant: float  # the score without a classifier

    def scores(self, rows: list[tuple]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.constant)
        x = np.column_stack(self.lexicon.matrices(rows))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -50, 50)))


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the fit rows, written once."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    lab = lab.filter("_id is not null and _toxic in (0, 1)").filter(~_held_out("_id"))
    lab = lab.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    n = lab.count()
    if n > FIT_ROWS:
        lab = lab.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < F.lit(FIT_ROWS * (1 << 20) // n))
    # about FIT_ROWS ids at most, so the texts of other documents don't move
    d = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text")).join(F.broadcast(lab), "_id")
    d = d.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_toxic").alias("_toxic"))
    d = d.withColumn("_w", words_of(F.col("text")))
    shingles = F.expr("transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]))")
    d = d.withColumn("_key", F.when(F.size("_w") < 5, F.xxhash64("text")).otherwise(F.array_min(shingles)))
    one = F.min(F.struct("_id", "text", "_toxic")).alias("_d")
    return materialise(d.groupBy("_key").agg(one).select("_d.text", F.col("_d._toxic").alias("toxic")))


def _candidates(rows: DataFrame) -> DataFrame:
    """Each term's occurrences in clean rows, and the clean (b) and toxic (a) rows that hold it once, twice ...; term '' counts words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, found = {(t, k): Counter() for t in (0, 1) for k in OFTEN}, Counter()
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                c = count_candidates(text)
                for k in OFTEN:
                    docs[toxic, k].update(c.keys() if k == 1 else [t for t, n in c.items() if n >= k])
                if not toxic:
                    found.update(c)
                    found[""] += len(words(text))
        terms = sorted({*docs[1, 1], *found})
        for s in range(0, len(terms), 50_000):
            part = terms[s : s + 50_000]
            columns = [pa.array([c[t] for t in part], pa.int64()) for c in (found, *docs.values())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *columns], names=names)

    names = ["term", "found", *[f"{'ba'[t]}{k}" for t in (0, 1) for k in OFTEN]]
    each = rows.mapInArrow(count, ", ".join(f"{c} {'string' if c == 'term' else 'long'}" for c in names))
    return each.groupBy("term").agg(*[F.sum(c).alias(c) for c in names[1:]])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = fit_rows(docs, labels)
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    constant = n_toxic / max(n_toxic + n_clean, 1)
    if not n_toxic or not n_clean:
        return Model(Lexicon([], np.empty(0), np.empty(0, int)), None, constant)
    terms = materialise(_candidates(rows))
    clean_words = terms.filter("term = ''").select("found").first()
    best = F.max(F.struct("z", F.length("term").alias("l"), "a", "b", "found"))
    levels = F.explode(F.array(*[F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in OFTEN])).alias("_l")
    each = terms.filter("term <> ''").select("term", "found", levels).select("term", "found", "_l.a", "_l.b").filter(F.col("a") >= LEAST_DOCS)
    share = (F.col("a") + F.col("b")) / (n_toxic + n_clean)
    z = (F.col("a") / n_toxic - F.col("b") / n_clean) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_toxic + 1 / n_clean))
    good = each.withColumn("z", F.round(z, 9)).filter(F.col("z") >= LEAST_Z).groupBy("term").agg(best.alias("_b"))
    good = good.orderBy(F.desc("_b.z"), F.desc("_b.l"), "term").limit(5 * TERMS).select("term", "_b.a", "_b.b", "_b.found")
    lexicon = choose_terms([tuple(r) for r in good.collect()], n_toxic, clean_words.found if clean_words else 0)

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for b in batches:
            got = [shared.value.read(t, automaton) for t in b.column("text").to_pylist()]
            lists = [pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([g[0] for g in got], pa.int32()), *lists], names=["toxic", "n", "i", "c", "p"])

    fit = rows.mapInArrow(read, "toxic int, n int, i array<int>, c array<int>, p array<int>").collect()  # FIT_ROWS rows, of counts only
    labelled = np.array([r.toxic for r in fit])
    excess, votes = lexicon.matrices([(r.n, r.i, r.c, r.p) for r in fit])
    target = label_posterior(votes, labelled)
    return Model(lexicon, logistic(np.column_stack([excess, votes]), target), constant)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: (doc_id, toxic 0 or 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    schema = StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.lexicon.automaton()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                s = model.scores([model.lexicon.read(t, automaton) for t in part.column("text").to_pylist()])
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc_id", _held_out().alias("held_out"), text_of().alias("text")).mapInArrow(run, schema)
