"""Connected components of a table of links, by rounds of joins and grouped minima.

Each round points every node at the smallest node seen around it: first every larger neighbour,
then every smaller one (large-star and small-star). Links turn into stars whose centre is the
smallest node of the component; the number of rounds grows with the logarithm of its size. Every
round is written to the shared folder, so neither lineage nor the driver grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def _minimum(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    low = _minimum(links)
    moved = links.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(links: DataFrame) -> bool:
    """Has every node either one smaller neighbour and no larger one, or larger ones alone?"""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = both.groupBy("u").agg(
        F.count_if(F.col("v") < F.col("u")).alias("smaller"), F.count_if(F.col("v") > F.col("u")).alias("larger")
    )
    return sides.filter("smaller > 1 OR (smaller > 0 AND larger > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; the component is its smallest node.

    Links in either direction, repeated links and links of a node with itself are fine; nodes are
    of any orderable type. No links give no rows.
    """
    ordered = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = materialise(ordered.distinct(), "links")
    while not _is_stars(stars):
        stars = materialise(_small_star(_large_star(stars)), "links")
    # A centre is nobody's u, so the two parts have no node in common.
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
