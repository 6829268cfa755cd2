"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, and every round is written to the shared
folder, so lineage stays short and no links ever meet in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least node around it."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.where("v > u").join(_least_neighbour(both), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v); the root is the least node reached.

    Null ends and links of a node to itself are left out; an empty table gives no rows.
    """
    current = stored(links.where("u is not null and v is not null and u <> v").distinct(), "links")
    state = _state(current)
    while state[0]:
        following = stored(_small_star(_large_star(current)), "links")
        new = _state(following)
        discard(current)
        current = following
        if new == state:
            break
        state = new
    ends = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return ends.union(roots)
