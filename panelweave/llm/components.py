"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links (larger to smaller node) are stars: every larger node has one link, and no centre is a larger node."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR out = 1 AND into = 1").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """node, root for every node in ``links`` (columns a, b): the smallest node it is linked with.

    Each round rewires the links around a node to the smallest neighbour; a star of any
    size is aggregated before its links are written anew, and the rounds, written to the
    scratch folder, grow with the logarithm of the longest chain.  Stops when all links
    are stars.
    """
    now = written(_edges(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    while not _settled(now):
        # Large star: from each node, larger neighbours (both directions seen) go to the smallest one known.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _edges(large)
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(_edges(small.unionByName(low.select("a", F.col("m").alias("b")))), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
