"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import settled


def _lowest(links: DataFrame) -> DataFrame:
    """(u, lowest): the smallest of u and all it is linked to, for links (u, v).

    Written before it is joined: the links of one node are split by skew then.
    """
    return settled(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("lowest")), "lowest")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("lowest").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = links.where("u > v")
    moved = low.join(_lowest(low), "u")
    return moved.where("v > lowest").select(F.col("v").alias("u"), F.col("lowest").alias("v")).unionByName(
        moved.select("u", F.col("lowest").alias("v"))
    )


def components(links: DataFrame) -> DataFrame:
    """(u, root) of every node that has a link: the smallest node it reaches, for links (u, v).

    Each round is two grouped minima and two joins; links only ever become
    shorter, and after a number of rounds that grows with the logarithm of the
    nodes, every node is linked to its root alone.  No links, no rows.
    """
    links = settled(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        links = settled(_small_star(_large_star(links).distinct()).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = links.select("u", F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
