"""Connected components of a table of links, as joins and group-bys only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    r = both.join(least, "a").filter("b > a")
    return r.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    r = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return r.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a long, b long): label is the least node it is linked to.

    Alternating large and small stars: each round points nodes at the least of their neighbours, until
    only stars are left.  The rounds grow with the logarithm of the longest chain; group-bys combine before
    the shuffle, so a hub with very many links is no burden.  Nodes without links don't appear.
    """
    e = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # a star forest: every node has one edge, and no node is both an end and a centre
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("x")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("x")))
        ends = ends.groupBy("node").agg(F.sum("x").alias("n"), F.min("x").alias("least"))
        if ends.filter("n > 1 or n = 1 and least = 0").isEmpty():
            break
        e = materialise(_small_star(_large_star(e)))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
