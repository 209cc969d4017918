"""Chat rendering of maximal conversations (operator 4), in DataFrame operations.

A log that snapshots conversations as they grow holds many prefixes of longer conversations.  Each turn is
hashed with its place; the exclusive-or of the hashes up to a turn is the rolling hash of that prefix (two
independent 64-bit ones, and the number of turns).  A conversation whose whole hash is among the proper
prefixes of others is dropped by an anti-join; of equal conversations the one with the least conv_id stays.
Only what stays is gathered, in turn order, and rendered.

Hot first turns and conversations are combined before each shuffle: prefixes are made distinct, and equal
conversations are counted by a group-by.  Texts are shuffled once, and only those of conversations that stay.

Defined results: repeated rows count once; equal turn numbers are ordered by role, then text hash; null turns
come first; null roles and texts render as empty; rows without a conv_id form one conversation of id null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Stands for a missing conv_id: below every long, so that no conversation has it.
_NO_ID = Decimal(-(2**63) - 1)


def _id():
    return F.coalesce(F.col("conv_id").cast("long").cast("decimal(20,0)"), F.lit(_NO_ID).cast("decimal(20,0)")).alias("c")


def prefixes(conversations: DataFrame) -> DataFrame:
    """(c, n, x, y): for each conversation and number of turns, the rolling hashes of that prefix."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        _id(), F.col("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit(7), text, role).alias("g"),
    ).distinct()
    order = Window.partitionBy("c").orderBy("turn", "role", "h", "g")
    rows = rows.withColumn("n", F.row_number().over(order).cast("long"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "c", "n", F.bit_xor(F.xxhash64("n", "h")).over(upto).alias("x"), F.bit_xor(F.xxhash64("n", "g", "h")).over(upto).alias("y")
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(c, n_turns, n_copies) of the conversations that no other one begins with."""
    p = materialise(prefixes(conversations))
    size = p.groupBy("c").agg(F.max("n").alias("n"))
    whole = p.join(size, ["c", "n"])
    part = p.join(size.withColumnRenamed("n", "last"), "c").filter("n < last").select("n", "x", "y").distinct()
    same = whole.groupBy("n", "x", "y").agg(F.min("c").alias("c"), F.count("*").alias("n_copies"))
    return same.join(part, ["n", "x", "y"], "left_anti").select("c", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of each maximal conversation."""
    top = materialise(maximal(conversations))
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        _id(),
        F.struct(F.col("turn"), role.alias("role"), F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit(7), text, role).alias("g"), text.alias("text")).alias("t"),
    ).join(top, "c")
    one = turns.groupBy("c").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_set("t")).alias("t")
    )
    line = lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
    return one.select(
        F.nullif("c", F.lit(_NO_ID)).cast("long").alias("conv_id"), "n_turns", "n_copies", F.array_join(F.transform("t", line), "").alias("rendered")
    )


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, COUNT(*) AS n_turns,
         STRING_AGG('<|im_start|>' || role || CHR(10) || text || '<|im_end|>' || CHR(10), '' ORDER BY turn) AS rendered
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id),
one AS (SELECT MIN(conv_id) AS conv_id, n_turns, COUNT(*) AS n_copies, rendered FROM c GROUP BY n_turns, rendered)
SELECT conv_id, n_turns, n_copies, rendered FROM one
WHERE NOT EXISTS (SELECT 1 FROM one d WHERE d.n_turns > one.n_turns AND STARTS_WITH(d.rendered, one.rendered))
"""
