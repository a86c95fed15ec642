"""Connected components of a table of links, by contraction. No set of links ever leaves the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.workspace import written


def _roots(links: DataFrame, write: Callable) -> DataFrame:
    """(a, p): every node points to the least of itself and its neighbours, and by pointer jumping to where that ends."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    parents = write(least.select("a", F.least("a", "m").alias("p")), "parents")
    while True:
        up = parents.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jumped = parents.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
        jumped = write(jumped, "parents")
        if jumped.where("moved").isEmpty():
            return parents
        parents = jumped.drop("moved")


def components(links: DataFrame, write: Callable = written) -> DataFrame:
    """(a, b) for every node that has a link and is not the least of its component b.

    links: (a, b), in any direction, repeats allowed. Each round contracts every tree of pointers to its root and keeps
    the links between different roots, at most half as many nodes; rounds are written tables, so a lost executor costs
    little. There is no row for each pair of a component, but one for each node. write: what writes the tables.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = write(links.distinct(), "links")
    labels = None
    while labels is None or not links.isEmpty():
        roots = _roots(links, write)
        if labels is None:
            labels = roots
        else:  # roots of the round before are the nodes of this one
            up = roots.select(F.col("a").alias("p"), F.col("p").alias("q"))
            labels = write(labels.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "labels")
        first = links.join(roots.withColumnRenamed("p", "pa"), "a")
        second = first.join(roots.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        links = second.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
        links = write(links.distinct(), "links")
    return labels.where("a <> p").select("a", F.col("p").alias("b"))
