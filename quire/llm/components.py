"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) -> node, root: the smallest node reachable, for every node that has a link.

    Each round replaces links by links to smaller nodes; it ends when every component is a
    star around its smallest node. Rounds grow with the logarithm of the longest path. All state
    is a link table on the shared folder; only its size and checksum reach the driver.
    """
    links = materialise(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    state = None
    for _ in range(rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour or itself.
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(small, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo <> hi")
        links = materialise(tied.union(small.select(F.col("m").alias("lo"), "hi")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select(F.col("lo"), F.col("lo"))).distinct()
