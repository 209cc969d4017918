"""Near-duplicate groups by weighted MinHash signatures from hashed darts (operator 6).

A document is the multiset of its five-word shingles (a text of one to four words is one shingle); its
weights are the shingle counts, and the similarity of two documents is the weighted Jaccard similarity
of those counts: the sum of the lesser over the sum of the greater weights.

Signatures: an element of weight w (any positive number) owns the region [0, w) x [0, inf) of weight by
rank.  The region is cut into strips [0, 1), [1, 2), [2, 4), [4, 8) ... of weight and each strip into cells
of area one; a hash of element, strip and cell throws its darts, the same for every document.  A document
keeps the darts below its weights and below its own rank limit, chosen so that about K ln K + 2K darts in
all remain whatever its size; a hash deals each dart to one of K coordinates, and the earliest (least rank)
of each coordinate is the signature.  Two documents agree on a coordinate with the probability of their
weighted similarity.  If a coordinate got no dart, the limit is doubled for that document.

Banded join: BANDS hashes of ROWS coordinates each.  Pairs are compared exactly, on whole texts; links make
components.  In a bucket of up to FEW members every pair of different components is compared (their number
has a fixed bound).  In a larger one the member that meets most others leads and is compared with the rest.
A bucket whose members are then of one component is done.  In the rest, let p be the leader, M(x) what x
lacks of p and E(x) what x has beyond p.  Two members of different components are as similar as asked only

* if they share enough of E, as |x & y| is at most the lesser of |x & p| and |y & p| plus |E(x) & E(y)|; or
* where that demands nothing (members smaller than p), if they share enough of M and E together: for
  |x & y| = |p| - |M(x)| - |M(y)| + |M(x) & M(y)| + |E(x) & E(y)|, and one of the two isn't linked to p.

So each member writes its differences without as many of the most frequent ones as the demand allows (a sample
of SAMPLE members of each leader tells which are frequent; any one order would do), and equal differences make
the buckets of the next level, where FEW is four times as large.  No link that the bands found is lost, and no
large bucket is expanded into all of its pairs.

Chances: a pair of similarity s shares a bucket with probability 1 - (1 - s**ROWS)**BANDS, 0.99993 at 0.8.

Defined results: texts that differ in white space only are copies, grouped before any signature is used;
documents without words, and those without a doc_id, are never linked; documents that share a doc_id are
one node; class_id is the least doc_id of a group (null without a doc_id); an empty table gives an empty
result; other columns are ignored by :func:`classes` and passed through by :func:`keep`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small, text_of, words_of
from .components import components
from .rolling import MULTIPLIER, lists, mix, places, slices, windows, word_hashes

SHINGLE = 5
BANDS, ROWS = 24, 5
SIMILARITY = 0.8
#: Candidate lists of up to this many document ids are broadcast to pick texts; longer ones join by shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket whose pairs (496 at most) are all compared, at the first level.
FEW = 32
#: Buckets in which a leader stands under another one before that one leads its buckets too.
AGAIN = 2
#: Words hashed into elements at a time, which bounds a worker's memory (a longer document is taken alone).
SIGNED_WORDS = 120_000
#: Pairs of one leader in one slot of the comparing join.
SLOT = 4_000
#: Members of a leader whose differences set the order of all.
SAMPLE = 64
#: Pairs whose differences are held at once while they are compared.
TOGETHER = 256


def shingled(flat: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of each row, sorted by row and hash."""
    sizes = np.diff(offsets)
    row, place = places(offsets)
    h = windows(flat, width, 2)
    fits = place[: len(h)] + width <= sizes[row[: len(h)]]
    h, r = h[fits], row[: len(h)][fits]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        own = np.array([windows(flat[offsets[i] : offsets[i + 1]], int(sizes[i]), 2)[0] for i in short], np.uint64)
        h, r = np.concatenate([h, own]), np.concatenate([r, short])
    order = np.lexsort((h, r))
    return r[order], h[order]


def _first_of_run(r: np.ndarray, h: np.ndarray) -> np.ndarray:
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.flatnonzero(new)


def weighted(flat: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row."""
    r, h = shingled(flat, offsets, width)
    at = _first_of_run(r, h)
    return r[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def units(flat: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the unit elements of each row: (shingle, occurrence) pairs, sorted by row and hash.

    The k-th occurrence of a shingle in a row is an element of weight one, so that set operations on units
    are multiset operations on shingles.
    """
    r, h = shingled(flat, offsets, width)
    at = _first_of_run(r, h)
    nth = (np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))).astype(np.uint64)
    with np.errstate(over="ignore"):
        e = mix(h + nth * MULTIPLIER)
    order = np.lexsort((e, r))
    return r[order], e[order]


def _poisson_cdf() -> np.ndarray:
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index repeated n[index] times, 0 .. n[index] - 1)."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _unit_interval(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def signatures(row: np.ndarray, e: np.ndarray, w: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) least dart ranks of n documents with elements e of weights w; infinite without elements."""
    cdf = _poisson_cdf()
    total = np.bincount(row, w, minlength=n)
    sig = np.full(n * k, np.inf)
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    # strips of weight: [0, 1), then [2**(s-1), 2**s) for s = 1, 2, ... as far as the weight reaches
    strips = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))), 0).astype(np.int64) + 1
    with np.errstate(over="ignore"):
        while todo.any():
            open_ = np.flatnonzero(todo[row])
            i, s = _spread(strips[open_])
            i = open_[i]
            low = np.where(s > 0, 2.0 ** (s - 1), 0.0)
            wide = np.where(s > 0, low, 1.0)
            j, c = _spread(np.ceil(limit[row[i]] * wide).astype(np.int64))  # cells of area one along the rank
            i, s, low, wide = i[j], s[j], low[j], wide[j]
            x = mix(e[i] ^ mix((c * 64 + s).astype(np.uint64) + np.uint64(0x1D)))
            j, d = _spread(np.searchsorted(cdf, _unit_interval(x)))
            i, low, wide, c = i[j], low[j], wide[j], c[j]
            x = mix(x[j] + (d.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)
            rank = (c + _unit_interval(x)) / wide
            place = low + wide * _unit_interval(mix(x + np.uint64(0x5B)))
            hit = (rank < limit[row[i]]) & (place < w[i])
            x, rank, r = x[hit], rank[hit], row[i[hit]]
            at = r * k + ((mix(x ^ MULTIPLIER) >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(sig, at, rank)
            todo = todo & np.isinf(sig.reshape(n, k)).any(axis=1)
            limit = np.where(todo, limit * 2, limit)
    return sig.reshape(n, k)


def _signed(bands: int, rows: int):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, offsets, flat in slices(b.column(2), SIGNED_WORDS):
                n = end - at
                r, e, w = weighted(flat, offsets)
                sig = signatures(r, e, w, n, k).view(np.uint64).reshape(n, bands, rows)
                key = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
                with np.errstate(over="ignore"):
                    for j in range(rows):
                        key = mix(key * MULTIPLIER + sig[:, :, j])
                some = np.diff(offsets) > 0
                weight = np.bincount(r, w, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(weight, pa.int64()),
                        lists(key[some].view(np.int64).ravel(), np.where(some, bands, 0), pa.int64()),
                    ],
                    names=["doc_id", "ck", "weight", "bands"],
                )

    return run


def _unit_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, end, offsets, flat in slices(b.column(1), SIGNED_WORDS):
            r, e = units(flat, offsets)
            u = lists(e.view(np.int64), np.bincount(r, minlength=end - at), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), u], names=["node", "units"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), TOGETHER):
            part = b.slice(at, TOGETHER)
            both, more, less = [], [], []
            for x, y, led in zip(part.column("ua"), part.column("ub"), part.column("led").to_pylist(), strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                n = len(np.intersect1d(x, y, assume_unique=True))
                both.append(n)
                none = x[:0]
                more.append(np.setdiff1d(y, x, assume_unique=True) if led else none)
                less.append(np.setdiff1d(x, y, assume_unique=True) if led else none)
            array = lambda parts: lists(np.concatenate(parts), np.array([len(x) for x in parts], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("a", "b", "led")), pa.array(both, pa.int64()), part.column("na"), part.column("nb"), array(more), array(less)],
                names=["a", "b", "led", "both", "na", "nb", "more", "less"],
            )


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, content key (null without words), total weight and band hashes of every document."""
    w = words_of(text_of())
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), w.alias("_w"))
    d = d.select(
        "doc_id", F.when(F.size("_w") > 0, F.md5(F.concat_ws(" ", "_w"))).alias("ck"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h")
    )
    return d.mapInArrow(_signed(bands, rows), "doc_id long, ck string, weight long, bands array<bigint>")


def unit_lists(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, units): the sorted unit elements of the documents in ids (node)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(small(ids, BROADCAST_IDS), "node", "left_semi")
    return texts.select("node", word_hashes(text_of()).alias("_h")).mapInArrow(_unit_lists, "node long, units array<bigint>")


def compared(pairs: DataFrame, u: DataFrame) -> DataFrame:
    """Pairs (a, b, led) with both (size of the intersection), na, nb; where led, what b has beyond a and lacks of it.

    The units of a leader of very many pairs are dealt to as many slots as those pairs need.
    """
    slots = pairs.groupBy("a").agg((F.count("*") / SLOT).cast("int").alias("_most"))
    left = slots.join(u, F.col("a") == F.col("node")).select("a", F.col("units").alias("ua"), F.explode(F.sequence(F.lit(0), "_most")).alias("_s"))
    p = pairs.join(slots, "a").withColumn("_s", F.pmod(F.xxhash64("b"), F.col("_most") + 1).cast("int"))
    p = p.join(u.select(F.col("node").alias("b"), F.col("units").alias("ub")), "b").join(left, ["a", "_s"])
    p = p.select("a", "b", "led", "ua", "ub", F.size("ua").cast("long").alias("na"), F.size("ub").cast("long").alias("nb"))
    return p.mapInArrow(_compared, "a long, b long, led boolean, both long, na long, nb long, more array<bigint>, less array<bigint>")


def _leaders(buckets: DataFrame) -> DataFrame:
    """(key, a): the document that leads each bucket.

    First the member that meets most others over all its buckets, the least on a tie.  If that one stands under
    another leader in AGAIN buckets or more, the one of those that meets most leads in its place: a leader need not be
    a member, and so buckets of one group have one leader instead of many.
    """
    met = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    top = F.max(F.struct("met", (-F.col("node")).alias("m"), F.col("node").alias("a")))
    rows = buckets.join(met, "node").select("key", "node", "met")
    first = rows.groupBy("key").agg(top.alias("t")).select("key", F.col("t.a").alias("a"), F.col("t.met").alias("met"))
    first = materialise(first)
    # only leaders themselves can hand a bucket on
    under = buckets.select("key", "node").join(first.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    under = under.join(first, "key").filter("a <> node").groupBy("node", "a").agg(F.max("met").alias("met"), F.count("*").alias("times"))
    above = under.filter(f"times >= {AGAIN}").groupBy("node").agg(F.max(F.struct("met", (-F.col("a")).alias("m"), F.col("a").alias("up"))).alias("t"))
    above = above.select(F.col("node").alias("a"), F.col("t.up").alias("up"), F.col("t.met").alias("more"))
    return first.join(above, "a", "left").select("key", F.expr("case when more > met then up else a end").alias("a"))


def _labelled(df: DataFrame, label: DataFrame | None) -> DataFrame:
    """df (with a column node) with its label: that of its component, else itself."""
    if label is None:
        return df.withColumn("label", F.col("node"))
    return df.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(df: DataFrame) -> DataFrame:
    """df (key, node, weight, label) where its bucket holds several labels, with the number n of its members."""
    n = df.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x < _y")
    return df.join(n.select("key", "n"), "key")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, weight, label) of the differences that each member writes.

    The most frequent ones, by the leader's sample, are left out as far as what it must share allows; ties by hash.
    """
    for b in batches:
        for at in range(0, len(b), TOGETHER):
            part = b.slice(at, TOGETHER)
            keys, counts = [], []
            columns = [part.column(c) for c in ("a", "kind", "need", "e", "often", "times")]
            for a, kind, need, e, often, times in zip(*columns, strict=True):
                need = need.as_py()
                e, often, times = (np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in (e, often, times))
                rank = np.zeros(len(e), np.int64)
                if len(often):
                    k = np.minimum(np.searchsorted(often, e), len(often) - 1)
                    rank = np.where(often[k] == e, times[k], 0)
                with np.errstate(over="ignore"):
                    salt = mix(np.uint64(a.as_py() % 2**64) * MULTIPLIER + np.uint64(kind.as_py()))
                    h = mix(e.view(np.uint64) ^ salt)
                h = h[np.lexsort((h, rank))[: max(0, len(e) - need + 1)]]
                keys.append(h.view(np.int64))
                counts.append(len(h))
            i = pa.array(np.repeat(np.arange(len(part)), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys), pa.int64()), *(part.column(c).take(i) for c in ("node", "weight", "label"))],
                names=["key", "node", "weight", "label"],
            )


def _differences(found: DataFrame, label: DataFrame | None, t: float) -> DataFrame:
    """(key, node, weight, label): the buckets of the next level, from the compared pairs of leaders."""
    d = found.filter("led").select("a", F.col("b").alias("node"), "both", "na", F.col("nb").alias("weight"), "more", "less")
    d = _labelled(d, label)
    # done where all members are of one component: the leader itself was compared with each of them
    ends = d.groupBy("a").agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.min("weight").alias("least")).filter("_x < _y")
    d = materialise(d.join(ends.select("a", "least"), "a"))
    # the differences that are frequent among SAMPLE members of each leader: they only set the order, any would do
    order = Window.partitionBy("a").orderBy(F.xxhash64("node"))
    some = d.withColumn("_k", F.row_number().over(order)).filter(f"_k <= {SAMPLE}")
    often = some.select("a", F.explode(F.concat("more", F.transform("less", F.bitwise_not))).alias("e")).groupBy("a", "e").agg(F.count("*").alias("n"))
    often = often.filter("n > 1").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("e", "n"))).alias("o"))
    d = d.join(often, "a", "left").withColumn("often", F.col("o.e")).withColumn("times", F.col("o.n"))
    share = t / (1 + t)
    # cost: linked to the leader if it is at most ``_t``; two members must share the sum of their costs less _t
    d = d.withColumn("_c", (1 - share) * (F.col("na") - F.col("both")) + share * (F.col("weight") - F.col("both")))
    d = d.withColumn("_t", (1 - 2 * share) * F.col("na"))
    # what a partner, of t times this size and of the least size at least, must share of E; one that is linked to
    # the leader has only partners that are not, which have fewer than share * (size + na) elements of it
    beyond = F.ceil(share * (F.col("weight") + F.greatest(t * F.col("weight"), F.col("least"))) - F.col("both") - 1e-6)
    beyond = F.when(F.col("_c") <= F.col("_t"), F.greatest(beyond, F.ceil(share * (F.col("weight") - F.col("na")) - 1e-6))).otherwise(beyond)
    either = F.ceil(F.when(F.col("_c") > F.col("_t"), (1 + t) * (F.col("_c") - F.col("_t"))).otherwise(F.col("_c")) - 1e-6)
    # a small enough partner may share nothing of E; of two such members, one that isn't linked has a partner no larger than p
    reach = F.least(F.expr(f"{1 / share!r} * both - weight + 1e-6"), F.when(F.col("_c") > F.col("_t"), F.col("na")).otherwise(F.lit(2.0**62)))
    near = (reach >= F.greatest("least", t * F.col("weight"))) & ((F.col("_c") > F.col("_t")) | (F.col("weight") <= F.col("na")))
    need = lambda n: F.greatest(n, F.lit(1)).cast("long").alias("need")
    own = ("a", "node", "weight", "label", "often", "times")
    rows = d.select(*own, F.lit(0).alias("kind"), need(beyond), F.col("more").alias("e")).unionByName(
        d.filter(near).select(*own, F.lit(1).alias("kind"), need(either), F.concat("more", F.transform("less", F.bitwise_not)).alias("e"))
    )
    return rows.filter("size(e) >= need").mapInArrow(_prefixes, "key long, node long, weight long, label long")


def _grouped(docs: DataFrame, buckets: DataFrame, t: float) -> DataFrame | None:
    """(node, label) of linked nodes, from buckets (key, node, weight); null if nothing is linked."""
    u = materialise(unit_lists(docs, materialise(buckets.select("node").distinct())))
    label, links, few = None, None, FEW
    buckets = buckets.withColumn("label", F.col("node"))
    while True:
        b = materialise(_open(buckets))
        count = b.agg(F.count("*").alias("rows"), F.count(F.when(F.col("n") > few, 1)).alias("large")).first()
        if not count["rows"]:
            return label if links is None else components(links)
        x, y = (b.filter(f"n <= {few}").select("key", *[F.col(c).alias(f"{c}{i}") for c in ("node", "weight", "label")]) for i in (1, 2))
        sizes = F.expr(f"least(weight1, weight2) >= {t} * greatest(weight1, weight2) - 1e-6")
        pairs = x.join(y, "key").filter("node1 < node2 and label1 <> label2").filter(sizes)
        pairs = pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b"), F.lit(False).alias("led"))
        if count["large"]:
            large = b.filter(f"n > {few}")
            led = large.join(_leaders(large), "key").filter("a <> node")
            pairs = pairs.unionByName(led.select("a", F.col("node").alias("b"), F.lit(True).alias("led")))
        pairs = materialise(pairs.groupBy("a", "b").agg(F.max("led").alias("led")))
        found = materialise(compared(pairs, u))
        new = found.filter(F.col("both") >= t * (F.col("na") + F.col("nb") - F.col("both")) - 1e-9).select("a", "b")
        links = new if links is None else links.unionByName(new)
        if not count["large"]:
            return components(links)
        if label is None:  # later levels are pruned by the components of the first one
            label = components(links)
            links = label.select(F.col("node").alias("a"), F.col("label").alias("b"))
        buckets = materialise(_differences(found, label, t))
        few *= 4


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id of every document."""
    s = materialise(signed(docs, bands, rows))
    content = s.filter("ck is not null and doc_id is not null").groupBy("ck").agg(
        F.min("doc_id").alias("node"), F.max("weight").alias("weight"), F.max("bands").alias("bands")
    )
    content = materialise(content)
    keys = content.select("node", "weight", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    label = _grouped(docs, materialise(keys.join(full.select("key"), "key").select("key", "node", "weight")), similarity)
    out = s.select("doc_id", "ck").join(content.select("ck", "node"), "ck", "left")
    if label is not None:
        out = out.join(label, "node", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("long"))
    return out.select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id")).alias("class_id")
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: the one with the least doc_id; rows without doc_id all stay.

    Rows that share a doc_id and have different texts are different documents: each counts under a hash of its id and text
    (also when the least id is sought), so one goes only if its own text is linked.  Repeated rows leave one.
    """
    hashed, whole = F.xxhash64(text_of()), [F.col(f"`{x}`") for x in docs.columns]
    d = docs.withColumn("_own_id", F.col("doc_id").cast("long"))
    often = d.filter("_own_id is not null").groupBy("_own_id").agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("lo"), F.max(hashed).alias("hi"))
    often = materialise(often.filter("n > 1").select(F.col("_own_id").alias("_often"), (F.col("lo") != F.col("hi")).alias("_shared")))
    repeats = not often.isEmpty()
    if repeats:  # usually there are none
        d = d.join(small(often, BROADCAST_IDS), F.col("_own_id") == F.col("_often"), "left")
        d = d.withColumn("_own_id", F.when(F.coalesce("_shared", F.lit(False)), F.xxhash64("_own_id", hashed)).otherwise(F.col("_own_id")))
    c = classes(d.select(F.col("_own_id").alias("doc_id"), "text"))
    gone = small(materialise(c.filter("class_id <> doc_id").select(F.col("doc_id").alias("_own_id")).distinct()), BROADCAST_IDS)
    left = d.join(gone, "_own_id", "left_anti")
    if not repeats:
        return left.select(*whole)
    one = left.filter("_often is not null").dropDuplicates(["_own_id"])
    return left.filter("_often is null").select(*whole).unionByName(one.select(*whole))
