"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.session import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs below one root, and no root below another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("root"), F.col("v").alias("lo"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0), F.lit(1), F.lit(None).cast("long")))
    ends = ends.groupBy("x").agg(F.max("below").alias("b"), F.max("root").alias("r"), F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    return ends.where("(b = 1 AND r = 1) OR lo <> hi").limit(1).count() == 0


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the links (a, b), component being its smallest node.

    Every node is hung below its smallest neighbour, and smaller neighbours below the smallest, in turn, until all hang below
    roots; that takes a few rounds even for long chains. Each round is two grouped minima, which add up before the
    shuffle, and joins whose large keys Spark can split, so the neighbours of a node never meet in one task. Rounds
    are written to the scratch folder; the driver sees counts only. Links with null ends and loops are left out.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(edges, "links")
    while not _settled(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.write(large.distinct(), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("x", "m")).where("u <> v")
        after = scratch.write(small.distinct(), "links")
        scratch.drop(edges, large)
        edges = after
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
