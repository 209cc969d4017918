"""Removal of repeated passages by difference-cover anchors (operator 9).

A window of WIDTH consecutive words is repeated if the same words also start anywhere else in the corpus.
Hashing and shuffling every window costs too much, so short anchors of ANCHOR words are hashed only where
their place in the document, modulo PERIOD, lies in a difference cover: a set whose pairwise differences
meet every residue.  Wherever two equal windows stand, some offset below PERIOD puts both on cover places,
and the anchor there lies inside both windows (ANCHOR + PERIOD - 1 = WIDTH).  So:

1. anchors (24 of 100 places) are dealt by hash; those that occur twice or more are kept;
2. kept anchors extend: each window around one is hashed whole, dealt, and counted;
3. words under a repeated window are removed.

Hot passages: what repeats inside one slice of a batch is found there, and one row stands for it in the
shuffle, so a passage in a third of all documents sends one row for each slice, not for each place.
The text is shuffled once, by document; both joins read that one exchange.

Defined results: a null text stays null and has no words; texts shorter than a window lose nothing;
repeated rows are occurrences of their own, so both copies lose their common windows; documents that
share or lack a doc_id are kept apart; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import text_of, words_of
from .rolling import MULTIPLIER, mix, places, slices, windows, word_hashes

WIDTH = 35
PERIOD = 21
#: A perfect difference set modulo 21.
COVER = (3, 6, 7, 12, 14)
ANCHOR = WIDTH - PERIOD + 1

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Key of the rows that only tell that a hash repeats; their negative code is never read back.
_TOLD = -(2**63)
#: Codes hold a place in their low 32 bits, then the row's number among those of its doc_id, then this mark.
KNOWN = 1 << 62
#: Anchors only pick what is hashed again, so fewer bits do: a chance meeting costs a little work, no result.
ANCHOR_BITS = 48


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _rows(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _dealt(h: np.ndarray, key: pa.Array, code: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows (h, key, code) for a shuffle by h.

    What occurs twice here is known to repeat: its places carry KNOWN in their code and go under keys of
    their own, spread over all tasks, and one row with code -1 tells the others.
    """
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    first = ~same
    many = same.copy()
    many[:-1] |= same[1:]
    known = np.zeros(len(s), bool)
    known[order] = many
    with np.errstate(over="ignore"):
        out = np.where(known, mix(h + MULTIPLIER * (np.arange(len(h), dtype=np.uint64) + np.uint64(1))), h)
    told = s[first & many]
    n = len(told)
    return _rows(
        names,
        pa.array(np.concatenate([out, told]).view(np.int64)),
        pa.concat_arrays([key, pa.array(np.full(n, _TOLD), pa.int64())]),
        pa.array(np.concatenate([code + known * KNOWN, np.full(n, -1, np.int64)])),
    )


_DEALT = "h long, k long, code long"
_NAMES = ["h", "k", "code"]


def _anchors(width: int, period: int, cover: tuple[int, ...]):
    a = width - period + 1
    inside = np.isin(np.arange(period), cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, offsets, flat in slices(b.column(1)):
                h = windows(flat, a)
                row, place = places(offsets)
                row, place = row[: len(h)], place[: len(h)]
                use = inside[place % period] & (place + a <= np.diff(offsets)[row]) & (np.diff(offsets)[row] >= width)
                low = h[use] & np.uint64((1 << ANCHOR_BITS) - 1)
                yield _dealt(low, b.column(0).slice(at, end - at).take(pa.array(row[use])), place[use], _NAMES)

    return run


def _whole_windows(width: int, period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.select(["k", "_n", "_words", "_at"])
            b = b.filter(b.column(3).is_valid())
            if not len(b):
                continue
            starts = b.column(3)
            for at, end, offsets, flat in slices(b.column(2)):
                row, place = places(offsets)
                mark = np.zeros(len(flat) + 1, np.int64)
                part = starts.slice(at, end - at)
                p = np.asarray(part.flatten())
                r = np.repeat(np.arange(end - at), np.asarray(part.value_lengths()))
                fits = p + (width - period + 1) <= np.diff(offsets)[r]  # a longer document may share the doc_id
                p, r = p[fits], r[fits]
                np.add.at(mark, offsets[r] + np.maximum(p - period + 1, 0), 1)
                np.add.at(mark, offsets[r] + p + 1, -1)
                h = windows(flat, width, 1)
                near = np.cumsum(mark)[: len(h)] > 0
                row, place = row[: len(h)], place[: len(h)]
                use = near & (place + width <= np.diff(offsets)[row])
                n = np.asarray(b.column(1).slice(at, end - at)).astype(np.int64)
                yield _dealt(h[use], b.column(0).slice(at, end - at).take(pa.array(row[use])), place[use] + (n[row[use]] << 32), _NAMES)

    return run


def _repeated(rows: DataFrame, *lists: Column) -> DataFrame:
    """k and lists made of the codes whose hash occurs twice or more (bounded by the places of one document)."""
    n = F.count("*").over(Window.partitionBy("h"))
    hit = rows.withColumn("_n", n).filter(((F.col("code") >= KNOWN) | (F.col("_n") > 1)) & (F.col("code") >= 0))
    return hit.withColumn("code", F.col("code") % KNOWN).groupBy("k").agg(*lists)


def cut_text(text: str, starts: np.ndarray, width: int) -> tuple[str, int, int]:
    """(text without the words under a window from starts, words, words removed); spaces follow their word."""
    spans = [m.span() for m in WORD.finditer(text)]
    mark = np.zeros(len(spans) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + width, -1)
    gone = np.cumsum(mark[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    parts, at = [], 0
    for a, z in edge.reshape(-1, 2):
        parts.append(text[at : spans[a][0]])
        at = spans[z][0] if z < len(spans) else len(text)
    return "".join(parts) + text[at:], len(spans), int(gone.sum())


def _cut(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, removed = [], []
            for t, n, first, codes in zip(*(b.column(c) for c in ("text", "_n", "_first", "_codes")), strict=True):
                t, n, starts = t.as_py(), n.as_py(), np.zeros(0, np.int64)
                if n == 1 and first.is_valid:
                    starts = np.asarray(first.values).astype(np.int64)
                elif codes.is_valid:
                    c = np.asarray(codes.values)
                    starts = c[c >> 32 == n] & 0xFFFFFFFF
                if t is None or not len(starts):
                    text.append(t)
                    removed.append(0)
                else:
                    t, _, gone = cut_text(t, starts, width)
                    text.append(t)
                    removed.append(gone)
            done = {"text": pa.array(text, pa.string()), "_removed": pa.array(removed, pa.int64())}
            yield _rows([*names, "_removed"], *[done[c] if c in done else b.column(c) for c in [*names, "_removed"]])

    return run


def cut(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """docs with repeated windows cut out of ``text``, and the number of words removed in ``_removed``."""
    if not is_cover(cover, period) or period > width:
        raise ValueError("the cover must meet every difference, and the period must not exceed the width")
    # inner columns must not clash with those of docs, so docs' others travel in one struct
    names = [c for c in docs.columns if c != "text"]
    base = docs.select(
        # rows may share a key, so a text's hash serves where there is no id and no key gathers all such rows
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))).alias("k"),
        F.col("text").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
    )
    anchors = base.select("k", word_hashes(text_of()).alias("_words")).mapInArrow(_anchors(width, period, cover), _DEALT)
    at = _repeated(anchors, F.collect_list(F.col("code").cast("int")).alias("_at"))
    numbered = base.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("text"))))
    found = numbered.join(at, "k", "left").withColumn(
        "_words", F.when(F.col("_at").isNotNull(), word_hashes(text_of()))
    )
    # places of a doc_id's first row (as a rule its only one) take half the room of full codes
    first = F.shiftright("code", 32) == 1
    again = _repeated(
        found.mapInArrow(_whole_windows(width, period), _DEALT),
        F.collect_list(F.when(first, (F.col("code") % 2**32).cast("int"))).alias("_first"),
        F.collect_list(F.when(~first, F.col("code"))).alias("_codes"),
    )
    schema = StructType([*[f for f in base.schema if f.name in ("text", "_row")], StructField("_removed", LongType())])
    out = numbered.join(again, "k", "left").mapInArrow(_cut(width, ["text", "_row"]), schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns], "_removed")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    kept = words_of(text_of())
    return cut(docs.select("doc_id", "text")).select(
        "doc_id",
        (F.size(kept) + F.col("_removed")).cast("long").alias("n_words"),
        F.col("_removed").alias("n_removed"),
        F.sha2(F.concat_ws(" ", kept).cast("binary"), 256).alias("kept_sha256"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated passages cut out of their text; a changed n_chars is set anew."""
    out = cut(docs)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_removed") > 0, n).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
