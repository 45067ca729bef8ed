"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import saved
from pairloom.operators import joins


def _least(links: DataFrame) -> DataFrame:
    """(a, least) with the smallest neighbour of each node, written; folds map-side, so hubs are cheap."""
    return saved(links.groupBy("a").agg(F.min("b").alias("least")), "least")


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest node around it.

    A hub's links are looked up among broadcast entries, so they stay where they are.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    root = F.least("least", "a")
    return joins.lookup(both, _least(both), ["a"]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), root.alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Needs a > b."""
    least = _least(links)
    joined = joins.lookup(links, least, ["a"])
    return (
        joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .unionByName(least.select("a", F.col("least").alias("b")))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link; root is the smallest node it can reach.

    ``links`` has two columns ``a`` and ``b`` of one sortable type. Each step is written to the shared
    folder; the number of steps grows with the logarithm of the longest chain.
    """
    links = links.filter(F.col("a") != F.col("b"))
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = saved(links, "links")
    mark = None
    while True:
        stars = _large_star(links).distinct()
        links = saved(_small_star(saved(stars, "links")).distinct(), "links")
        sums = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
