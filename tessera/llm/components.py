"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round over links (a > b). Large: every larger neighbour of a node links to the node's smallest
    neighbour. Small: every smaller neighbour, and the node, do. Minima are pre-aggregated before the
    shuffle and joined back, so a node with many links is split as a skewed join."""
    if large:
        both = links.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(links.select(F.col("b").alias("n"), F.col("a").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        moved = both.filter("m > n").join(least, "n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        joined = links.join(least, "a")
        moved = joined.filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    Self-links and repeated links do no harm. Each round is written to the shared folder, so a lost
    executor costs one round at most; the number of rounds grows with the logarithm of the longest path.
    """
    a, b = F.col(first).cast("long"), F.col(second).cast("long")
    now = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "components")
    before = None
    while True:
        # A forest of stars: no parent has a parent of its own, and each node has one parent.
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if state == before or not state[0]:
            break
        before = state
        then = stored(_stars(_stars(now, True), False), "components")
        drop_stored(now)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
