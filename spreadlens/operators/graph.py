"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlens.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node of its component.

    Two alternating rounds hang every node under the smallest node in reach until nothing moves. Each is one aggregate and
    one join, a hub's links are never gathered, and the table of each round is written, so a lost executor costs one round.
    """
    tied = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = stored(links.where("a <> b").select(*tied).distinct(), "links")
    state = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        links = stored(_to_smallest(_to_smallest(links, larger=True), larger=False), "links")
    # Links are now stars: (root, member).
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def _to_smallest(links: DataFrame, larger: bool) -> DataFrame:
    """Re-hang, for each node u, its larger (or its smaller) neighbours under the smallest node u knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = both.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not larger:
        ways = ways.where("v < u")
    smallest = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = ways.join(smallest, "u")
    if larger:
        hung = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        hung = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(smallest.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return hung.where("a <> b").distinct()
