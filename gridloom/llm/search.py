"""Ranked lexical search without an index (operator 11): the documents are read as a stream by an automaton of all item terms.

The terms of all items make one Aho-Corasick automaton.  Every term stands between two guards (a space), and every
character of a text that is no part of a term becomes a space, so the automaton reports whole terms only and their
counts come straight from the text.  Each term's output names the items that ask for it, so one reading of a document
serves all items.  A second step adds the scores in whole numbers and keeps, in each partition, the best documents of
each item; these few meet in windows at the end.

The automaton is sent to every executor, so its size is bounded: items are dealt into blocks of at most
``2 * BLOCK_TERMS`` pairs of item and term (or one single item), and each block reads the documents once.

Defined results: a null or empty text, and one without a term, counts for nothing; rows that share an item_id are one
item with the terms of all of them, a null item_id is an item of its own, an item without terms gets no rows; rows that
repeat a doc_id are separate documents; among equal scores rows without doc_id come last; an empty table on either side gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import materialise, text_of

#: Pairs of item and term in a block of items; an automaton of so many terms takes some tens of MB.
BLOCK_TERMS = 100_000
#: Documents kept for each item.
TOP = 10
#: Sums of so many item scores are worked on at a time, and so many cells of documents by items.
CHUNK_POSTINGS, CHUNK_CELLS = 2_000_000, 500_000
#: Partitions whose best documents meet in one window before all meet.
FAN_IN = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Each byte of UTF-8 as it stands in a term, or as a space.
_GUARDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""
    parts = F.split(F.translate(text_of(), _UPPER, _LOWER), NO_TERM)
    return items.select("item_id", F.explode(parts).alias("term")).filter("term <> ''").distinct()


def _blocks(terms: DataFrame) -> list[list[tuple]]:
    """Blocks of items as conditions (number of blocks, block): each of at most 2 * BLOCK_TERMS pairs, or one item."""
    total = terms.count()
    n = max(1, math.ceil(total / BLOCK_TERMS))
    while total:
        sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).groupBy(_block(n).alias("b"))
        sizes = sizes.agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("items"))
        if sizes.filter(F.col("pairs") > 2 * BLOCK_TERMS).filter("items > 1").isEmpty():
            return [(n, r.b) for r in sizes.select("b").orderBy("b").toLocalIterator()]
        n *= 2
    return []


def _block(n: int):
    return F.pmod(F.xxhash64("item_id"), F.lit(n))


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        a.add_word(f" {t.encode().decode('latin-1')} ", i)
    a.make_automaton()
    return a


def count_terms(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, np.ndarray, np.ndarray]:
    """All terms of a UTF-8 text, the numbers of the automaton's terms in it, and how often each occurs."""
    guarded = text.translate(_GUARDED)
    found = [i for _, i in automaton.iter(f" {guarded.decode('latin-1')} ")]
    terms, tf = np.unique(np.array(found, dtype=np.int32), return_counts=True)
    return len(guarded.split()), terms, tf.astype(np.int32)


def scan(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, term array<int>, tf array<int>) for every row with a term: what the automaton of terms reports."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    schema = StructType([docs.schema["doc_id"]]).add("n", LongType()).add("term", ArrayType(IntegerType())).add("tf", ArrayType(IntegerType()))
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for b in batches:
            rows = [count_terms(t.as_py(), automaton) for t in b.column("text")]
            some = [k for k, r in enumerate(rows) if r[0]]
            lists = [pa.array([rows[k][j] for k in some], pa.list_(pa.int32())) for j in (1, 2)]
            n = pa.array([rows[k][0] for k in some], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some, pa.int32())), n, *lists], schema=arrow)

    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(read, schema)


class Best:
    """The best TOP documents of each item so far: by falling score, then ids, rows without an id last."""

    def __init__(self, items: int, top: int):
        self.top, self.items = top, items
        self.item = np.empty(0, np.int64)
        self.score, self.doc, self.null = self.item.copy(), self.item.copy(), np.empty(0, bool)
        self._last(np.zeros(items, bool), slice(0, 0))

    def _last(self, full: np.ndarray, at) -> None:
        self.bar, self.bar_null, self.bar_doc = np.zeros(self.items, np.int64), np.zeros(self.items, bool), np.full(self.items, np.iinfo(np.int64).min)
        self.bar[full], self.bar_null[full], self.bar_doc[full] = self.score[at], self.null[at], self.doc[at]

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """scores: documents by items."""
        earlier = (null[:, None] < self.bar_null) | ((null[:, None] == self.bar_null) & (doc[:, None] < self.bar_doc))
        d, i = np.nonzero((scores > self.bar) | ((scores == self.bar) & (self.bar > 0) & earlier))
        if not len(d):
            return
        item, score = np.concatenate([self.item, i]), np.concatenate([self.score, scores[d, i]])
        doc, null = np.concatenate([self.doc, doc[d]]), np.concatenate([self.null, null[d]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.top]
        self.item, self.score, self.doc, self.null = item[place < self.top], score[order], doc[order], null[order]
        ends = np.flatnonzero(place[place < self.top] == self.top - 1)
        self._last(np.isin(np.arange(self.items), self.item[ends]), ends)


def _best_of_partitions(hits: DataFrame, ids: list, item_field: StructField, weights: np.ndarray, offsets: np.ndarray, postings: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    schema = StructType([item_field, StructField("doc_id", LongType()), StructField("score", LongType())])
    arrow = to_arrow_schema(schema)
    shared = hits.sparkSession.sparkContext.broadcast((ids, weights, offsets, postings))
    # sums of doubles are exact below 2 ** 53; a term adds less than its weight times a million
    exact = float(np.bincount(postings, minlength=len(ids)).max()) * float(weights.max()) * 1e6 < 2**53

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, offsets, postings = shared.value
        width, best = np.diff(offsets), Best(len(ids), top)
        for b in batches:
            null = np.asarray(b.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            doc = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            m = 10 + 90 * b.column("n").to_numpy() * n_docs // n_terms
            ends = np.cumsum([0, *b.column("term").value_lengths().to_pylist()])
            term, tf = b.column("term").flatten().to_numpy(), b.column("tf").flatten().to_numpy().astype(np.int64)
            adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(ends))))
            work = np.concatenate([[0], np.cumsum(width[term])])[ends]
            lo = 0
            while lo < len(doc):
                hi = int(np.searchsorted(work, work[lo] + CHUNK_POSTINGS, "right")) - 1
                hi = max(lo + 1, min(hi, lo + CHUNK_CELLS // len(ids), len(doc)))
                t, a = term[ends[lo] : ends[hi]], adds[ends[lo] : ends[hi]]
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                within = np.arange(work[hi] - work[lo]) - np.repeat(np.cumsum(width[t]) - width[t], width[t])
                cell = np.repeat(row * len(ids), width[t]) + postings[np.repeat(offsets[t], width[t]) + within]
                if exact:
                    sums = np.bincount(cell, np.repeat(a, width[t]), (hi - lo) * len(ids)).astype(np.int64)
                else:
                    sums = np.zeros((hi - lo) * len(ids), np.int64)
                    np.add.at(sums, cell, np.repeat(a, width[t]))
                best.add(sums.reshape(hi - lo, len(ids)), doc[lo:hi], null[lo:hi])
                lo = hi
        columns = [pa.array([ids[i] for i in best.item], arrow.field(0).type), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score)]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return hits.mapInArrow(choose, schema)


def _ranked(best: DataFrame, keys: list, top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _of_block(docs: DataFrame, pairs: list, item_field: StructField, top: int) -> DataFrame:
    ids = sorted({p.item_id for p in pairs}, key=lambda x: (x is None, x))
    terms = sorted({p.term for p in pairs})
    item_no, term_no = {x: i for i, x in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    pair = np.array(sorted((term_no[p.term], item_no[p.item_id]) for p in pairs), np.int64)
    offsets = np.searchsorted(pair[:, 0], np.arange(len(terms) + 1))

    hits = materialise(scan(docs, terms))
    n_docs, n_terms = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(hits.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect())  # a row for each term at most
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
    best = _best_of_partitions(hits, ids, item_field, weights, offsets, pair[:, 1], n_docs, max(n_terms, 1), top)
    return best.withColumn("part", F.expr(f"spark_partition_id() div {FAN_IN}"))


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of docs (doc_id, text) for each of items (item_id, text).

    Scores are those of the operator's contract: whole numbers, from the counts of the whole table.
    """
    field = StructField("item_id", items.schema["item_id"].dataType)
    terms = materialise(terms_of(items))
    best = None
    for n, b in _blocks(terms):
        one = _of_block(docs, terms.filter(_block(n) == b).collect(), field, top)  # bounded, see above
        best = one if best is None else best.unionByName(one)
    if best is None:
        schema = StructType([field, StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    best = _ranked(best, ["item_id", "part"], top)
    return _ranked(best.drop("rank"), ["item_id"], top).select("item_id", "rank", "doc_id", "score")


#: N, L, n, df and tf counted by joins of words; the same whole-number arithmetic.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[^{NO_TERM[1:]}') AS ts FROM documents),
s AS (SELECT COUNT(*) FILTER (len(ts) > 0) AS n_docs, SUM(len(ts))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, UNNEST(regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[^{NO_TERM[1:]}')) AS term FROM benchmark),
tf AS (SELECT r, term, COUNT(*) AS tf FROM (SELECT r, UNNEST(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY ALL),
x AS (SELECT item_id, r, SUM(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r), s GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
