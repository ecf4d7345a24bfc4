"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.sources.workspace import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected(links: DataFrame) -> DataFrame:
    """``links`` has two number columns a and b. Returns node, root for each node that isn't the
    smallest of its component; root is that smallest node.

    Each round is two aggregations, which are combined before the shuffle, each with a join back to
    the links. Every half-round is written to the shared folder, so a lost executor costs one
    half-round. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "links-least")
        large = stored(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "links-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(
            least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, "links-small")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
