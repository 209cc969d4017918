"""Shards along a Hilbert curve through document metadata (operator 10), in DataFrame operations only.

Four dimensions are quantised to BITS bits each: text size (its bit length), place of doc_id between
the least and the greatest, and MD5 digits of source and language.  Each cell of that grid has an index
on the Hilbert curve; rows are ordered by cell, then doc_id, then text checksum and size, and the order
is cut into runs of equal row counts (law ``rows``: counts differ by one at most), so that a shard covers
a compact part of the metadata space and file statistics prune on several dimensions at once.

The order is never made in one task: each cell is cut at SPLITS quantiles of doc_id into ranges (rows without one,
by their checksum), the ranges are counted by a combined group-by, running sums over the counts give every range
its offset, and rows are numbered within their range only.  The quantiles decide how the work is cut, not the order.

Defined results: a null text has size 1 and checksum 0; null metadata take the lowest quantum; rows that
are equal in all of these may swap places with each other only; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small, text_of

BITS = 3
#: Ranges of doc_id that cells are cut into, and (as a power of two) those of rows without one.
SPLITS = 256
NULL_BITS = 8
#: Tables of ranges up to this many rows are broadcast; longer ones join by shuffle.
BROADCAST_RANGES = 200_000
DIMS = ("q_source", "q_lang", "q_id", "q_size")


def hilbert_index(df: DataFrame, dims: tuple[str, ...], bits: int, out: str) -> DataFrame:
    """df with the Hilbert index of integer columns dims (0 to 2**bits - 1 each) in column out.

    Skilling's transform: from the highest bit down, a set bit inverts the lower bits of the first
    axis and an unset one swaps them with the axis; then a Gray code over all axes.
    """
    x = [f"_x{i}" for i in range(len(dims))]
    for c, d in zip(x, dims, strict=True):
        df = df.withColumn(c, F.col(d).cast("long"))
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i, c in enumerate(x):
            bit = F.col(c).bitwiseAND(F.lit(1 << b)) != 0
            if i == 0:
                df = df.withColumn(c, F.when(bit, F.col(c).bitwiseXOR(F.lit(low))).otherwise(F.col(c)))
            else:
                df = df.withColumn("_t", F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(F.lit(low))).withColumn("_b", bit)
                df = df.withColumn(x[0], F.col(x[0]).bitwiseXOR(F.when(F.col("_b"), F.lit(low)).otherwise(F.col("_t"))))
                df = df.withColumn(c, F.when(F.col("_b"), F.col(c)).otherwise(F.col(c).bitwiseXOR(F.col("_t"))))
    for i in range(1, len(x)):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    df = df.withColumn("_t", F.lit(0).cast("long"))
    for b in range(bits - 1, 0, -1):
        set_ = F.col(x[-1]).bitwiseAND(F.lit(1 << b)) != 0
        df = df.withColumn("_t", F.when(set_, F.col("_t").bitwiseXOR(F.lit((1 << b) - 1))).otherwise(F.col("_t")))
    for c in x:
        df = df.withColumn(c, F.col(c).bitwiseXOR(F.col("_t")))
    index: Column = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = index * 2 + F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long"))
    return df.withColumn(out, index).drop(*x, "_t", "_b")


def quantised(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32 and the quantised dimensions of every document."""
    top = (1 << bits) - 1
    t = text_of()
    size = (F.octet_length(t) + 1).cast("long")
    at = F.array(*[F.lit((k + 1) / SPLITS) for k in range(SPLITS - 1)])
    ends = docs.agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.percentile_approx(F.col("doc_id").cast("long"), at, 20 * SPLITS).alias("_cuts"))
    ends = materialise(ends)  # one row: safe to broadcast, and the same wherever it is read
    digit = lambda c: F.coalesce(F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 4), 16, 10).cast("long"), F.lit(0).cast("long")) % (top + 1)
    return docs.select(
        F.col("doc_id"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        digit("source").alias("q_source"), digit("lang").alias("q_lang"),
    ).crossJoin(F.broadcast(ends)).select(
        "doc_id", "size", "text_crc32", "q_source", "q_lang",
        F.coalesce(F.expr(f"cast((cast(doc_id as decimal(38,0)) - _lo) * {top + 1} div (cast(_hi as decimal(38,0)) - _lo + 1) as bigint)"), F.lit(0).cast("long")).alias("q_id"),
        F.least(F.greatest(F.length(F.bin("size")) - 5, F.lit(0)), F.lit(top)).cast("long").alias("q_size"),
        F.expr(f"case when doc_id is null then shiftright(text_crc32, {32 - NULL_BITS}) - {1 << NULL_BITS} else size(filter(_cuts, c -> c < doc_id)) end").cast("long").alias("range"),
    )


def shard(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the curve index cell."""
    rows = quantised(docs, bits)
    ranges = rows.groupBy(*DIMS, "range").agg(F.count("*").alias("_n"))
    ranges = materialise(hilbert_index(ranges, DIMS, bits, "cell"))
    # at most 2**(bits * dimensions) cells, 4,096 with the defaults: a bound that the input cannot pass
    cells = ranges.groupBy("cell").agg(F.sum("_n").alias("_c"))
    cells = cells.withColumn("_before", F.sum("_c").over(Window.orderBy("cell")) - F.col("_c")).withColumn(
        "_total", F.sum("_c").over(Window.partitionBy(F.lit(0)))
    )
    ranges = ranges.join(F.broadcast(cells), "cell").withColumn(
        "_before", F.col("_before") + F.sum("_n").over(Window.partitionBy("cell").orderBy("range")) - F.col("_n")
    )
    ranges = materialise(ranges.select(*DIMS, "range", "cell", "_before", "_total"))
    r = rows.join(small(ranges, BROADCAST_RANGES), [*DIMS, "range"])
    own = Window.partitionBy("cell", "range").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    r = r.withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1)
    r = r.withColumn("shard", F.expr(f"cast(_rank * {shards} div _total as int)"))
    return r.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"_rank - (shard * _total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "cell",
    )
