"""Connected components of a link table, wholly in Spark: alternating large and small stars.

Each round hangs every node's larger neighbours on its least neighbour (large star), then all
not-larger ones (small star); the table ends as stars whose centre is the least node. Rounds
grow with the logarithm of the longest path. Every round is written to the shared folder, so a
lost executor costs one round at most, and nothing but two sums per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
    return (
        both.where("b > a")
        .join(least, F.col("a") == F.col("u"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` holds (larger, smaller)."""
    least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = links.join(least, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two columns of one orderable type).

    The root is the least node reachable. Links from a node to itself, repeated links and links
    with a null end are allowed and add nothing; an empty table gives no rows.
    """
    a, b = links.columns
    state = written(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        state = written(_small_star(_large_star(state)), "stars")
    spokes = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return spokes.union(state.select("b", "b").distinct())
