"""Connected components of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rounds of large and small stars; each at least halves the longest way, so this is never met.
MAX_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for each node with a link: component is the smallest node reachable.

    Alternates large and small stars: each node ties its larger neighbours, then its smaller ones,
    to the smallest around it, until the links are stars. What is gathered about a node is one
    minimum, combined before the shuffle; a hub's links are split by adaptive joins.
    """
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        least = least.select("n", F.least("n", "m").alias("m"))
        # Large star: larger neighbours of a node go to its minimum.
        large = edges.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))
        large = checkpointed(large.where("u <> v").distinct())
        # Small star: the node and its smaller neighbours go to their minimum.
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("n"))
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select(F.col("n").alias("u"), F.col("m").alias("v"))
        )
        new = checkpointed(tied.where("u <> v").distinct())
        same = new.count() == edges.count() and not new.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if same:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")
