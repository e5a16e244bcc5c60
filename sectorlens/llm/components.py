"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    tied = both.where("v > u").join(least, "u").select(F.least("u", "m").alias("a"), F.col("v").alias("b"))
    return tied.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    smaller = tied.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smaller.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of the links ``(a, b)``; the component is its smallest node.

    Each pass writes its edges to the shared folder, so a lost executor repeats one pass at most.
    The number of passes grows with the logarithm of the longest path. Nodes without a link to
    another node don't appear; links with a null end, and of a node to itself, are left out.
    """
    edges = cut(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        edges = cut(_small_star(_large_star(edges)))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select("a").distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots.select("a", "a"))
