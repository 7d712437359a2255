"""Connected components of a graph of links, for graphs far larger than a driver.

Alternates the large-star and small-star steps of Kiveris et al. (2014): every round keeps the components and shortens all paths, so the
number of rounds grows with the logarithm of the longest path. Minimum labels are found by aggregation and joined back, so a node with a
third of all links is pre-combined map-side and its join can be split by AQE. Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censo.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least.hint("merge"), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least.hint("merge"), "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def thin_links(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links with the same components as ``links``, far fewer where many nodes are all linked with each other: one small-star step."""
    return _small_star(links.select(F.col(a).alias("u"), F.col(b).alias("v"))).select(F.col("v").alias(a), F.col("u").alias(b))


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node that has a link; ``component`` is the smallest node of its component.

    Links may come in any order, twice or as loops; null ends are no links. No links give no rows. Raises if ``most_rounds`` do not settle.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = e.select("u").unionByName(e.select(F.col("v").alias("u"))).distinct()
    e = cut(e.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        e = cut(_small_star(_large_star(e)))
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return nodes.join(e.hint("merge"), "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
