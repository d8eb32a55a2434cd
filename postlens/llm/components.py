"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.session import materialise


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of those."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(a, root): for each node of ``links`` (a, b), other than the roots, the smallest node it is connected to.

    Both columns are of one ordered type without nulls. Loops and repeated links do not matter; no links give no rows.
    Each round is written to the shared folder, and the rounds end when a further one changes nothing; their number
    grows with the logarithm of the largest component. Minima are combined before the shuffle and joins may be split,
    so that a node with very many links does not bind one task.
    """
    links = materialise(links.where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(state):
            return links.withColumnRenamed("b", "root")
        seen = tuple(state)
        links = materialise(_small_star(_large_star(links)), "links")
