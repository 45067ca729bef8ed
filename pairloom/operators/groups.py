"""Splits without leaks: pairs that share a text go to one side together.

Two rows are linked if one of the given columns is equal in both. Groups are what hangs together over any
number of links. They are dealt whole: groups in the order of a seeded rank fill the test set up to the
wanted size, and so no text is on both sides.

Components are found by contraction: every node points at its smallest neighbour if that is smaller,
pointers are followed to their ends by doubling, ends take the place of their nodes, and what links are
left go into the next round. Links are distinct pairs of digests, one per row at most; copies of a row
fold map-side. Ends are looked up by a join that broadcasts the entries of hot nodes, so a text that very
many rows share is no hot key. Each round is written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators import joins, order

GROUP = "group"


def _node(column: str, number: int) -> Column:
    """Digest of a column's value; the same value in two columns makes two nodes. Null stays null."""
    return F.when(F.col(column).isNotNull(), F.md5(F.concat(F.lit(f"{number}:"), F.col(column).cast("string"))))


def _pointers(links: DataFrame) -> DataFrame:
    """(node, end): each node's end when every node follows its smallest smaller neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    ends = order.written(least.select("node", F.least("node", "least").alias("end")), "pointers")
    while True:
        further = ends.select(F.col("node").alias("end"), F.col("end").alias("further"))
        followed = joins.lookup(ends, further, ["end"], "left").select("node", F.coalesce("further", "end").alias("next"), "end")
        followed = order.written(followed, "pointers")
        ends = followed.select("node", F.col("next").alias("end"))
        if followed.filter(F.col("next") != F.col("end")).isEmpty():
            return ends


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node with a link to another; ``links`` has columns a and b."""
    links = order.written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not links.isEmpty():
        ends = _pointers(links)
        if roots is None:
            roots = ends.withColumnRenamed("end", "root")
        else:
            # Nodes whose root has met a smaller one; roots without links are not among the ends.
            moved = ends.select(F.col("node").alias("root"), F.col("end").alias("further"))
            roots = joins.lookup(roots, moved, ["root"], "left").select("node", F.coalesce("further", "root").alias("root"))
        roots = order.written(roots, "roots")
        for side in ("a", "b"):
            links = joins.lookup(links, ends.select(F.col("node").alias(side), F.col("end").alias("end")), [side])
            links = order.written(links.drop(side).withColumnRenamed("end", side), "links")
        links = order.written(
            links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
        )
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _keyed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows, written, with ``__node``, and the (__node, __root) of those whose group has another name.

    The rows are computed once; of the written ones, all that follows reads the nodes only.
    """
    nodes = [_node(column, i) for i, column in enumerate(columns)]
    more = {f"__node{i}": node for i, node in enumerate(nodes[1:])}
    wide = order.written(df.withColumns({"__node": F.coalesce(*nodes, F.lit("none")), **more}), "grouped")
    keyed = wide.drop(*more)
    links = [wide.select(F.col("__node").alias("a"), F.col(name).alias("b")).filter("b IS NOT NULL") for name in more]
    if not links:
        return keyed, None
    roots = components(reduce(DataFrame.unionByName, links))
    return keyed, roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))


def _named(keyed: DataFrame, roots: DataFrame | None, name: str) -> DataFrame:
    if roots is None:
        return keyed.withColumn(name, F.col("__node"))
    return joins.lookup(keyed, roots, ["__node"], "left").withColumn(name, F.coalesce("__root", "__node")).drop("__root")


def with_groups(df: DataFrame, columns: Sequence[str] = ("en", "ko"), name: str = GROUP) -> DataFrame:
    """Rows with the name of their group, a digest. Rows that are null in all columns are one group."""
    keyed, roots = _keyed(df, list(columns))
    return _named(keyed, roots, name).select(*df.columns, name)


def split_groups(
    df: DataFrame, seed: int, columns: Sequence[str] = ("en", "ko"), n: int | None = None, fraction: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and test set that share no value of ``columns``.

    The test set has at most ``n`` rows, or ``ceil(fraction * rows)``, and fewer by less than the size of
    the largest group that fits into it. Groups larger than the test set stay in the training set.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    if fraction is not None and not 0 <= fraction <= 1:
        raise ValueError("the fraction must lie between 0 and 1")
    keyed, roots = _keyed(df, list(columns))
    total = keyed.count()
    wanted = n if n is not None else math.ceil(fraction * total)
    if not 0 <= wanted <= total:
        raise ValueError(f"test set of {wanted} is larger than the data set of {total}, or negative")
    # Groups are dealt by their nodes; rows are only met again with the nodes of the test set.
    nodes = order.written(keyed.groupBy("__node").agg(F.count("*").alias("n")), "nodes")
    grouped = order.written(_named(nodes, roots, "__group"), "nodes")
    sizes = grouped.groupBy("__group").agg(F.sum("n").alias("size"))
    rank = F.md5(F.concat(F.lit(f"{seed}:"), "__group"))
    fitting = order.written(sizes.filter(F.col("size") <= wanted).withColumn("rank", rank), "groups")
    before = order.prefix_sum(fitting, "rank", F.col("size"), "before")
    chosen = order.written(before.filter(F.col("before") + F.col("size") <= wanted).select("__group", F.lit(True).alias("__test")), "groups")
    chosen = order.written(joins.lookup(grouped, chosen, ["__group"]).select("__node", "__test"), "nodes")
    marked = joins.lookup(keyed, chosen, ["__node"], "left")
    test = F.coalesce("__test", F.lit(False))
    return marked.filter(~test).select(*df.columns), marked.filter(test).select(*df.columns)
