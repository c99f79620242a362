"""Connected components by alternating large and small stars, on DataFrames.

Edges are rows; every step is a grouped minimum (pre-aggregated before its shuffle) and an
equi-join whose skewed side Spark can split. Nothing is collected but a count and a checksum.

Defined cases. Without links the result is empty. Links from a node to itself and repeated links
change nothing; links with a null end are left out. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("c", "m").alias("m"))
    joined = both.join(least, both.u == least.c)
    out = joined.filter(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): long ids. (node, root) for every node that has a link to another; root is the least id reachable."""
    links = links.filter("a is not null and b is not null")
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = _checksum(edges)
    while True:
        last, edges = edges, stash(_star(_star(edges, True), False), "edges")
        discard(last)
        now = _checksum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
