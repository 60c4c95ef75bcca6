"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.plans.staging import Staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the least node reachable.

    Large-star and small-star rounds (Kiveris et al., SoCC 2014), each written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain. Each node's least neighbour is aggregated before
    the shuffle, and the join back on a node with very many links is one that adaptive execution splits.
    A link of a node with itself keeps the node. ``rows`` is about how many links there are, if known.
    """
    loops = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    now = Staged(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", rows)
    mark = _mark(now.df)
    while mark[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = Staged(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links", mark[0])
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.df.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Staged(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links", 2 * mark[0])
        large.discard()
        now.discard()
        now, last, mark = after, mark, _mark(after.df)
        if mark == last:
            break
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    alone = now.df.select(F.col("v").alias("node")).unionByName(loops).distinct().join(stars, "node", "left_anti")
    return stars.unionByName(alone.select("node", F.col("node").alias("root")))


def clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every row of ``vertices(node)``, those without links as their own root."""
    roots = connected_components(edges).withColumnRenamed("root", "_root")
    return vertices.join(roots, "node", "left").select("node", F.coalesce("_root", "node").alias("root"))
