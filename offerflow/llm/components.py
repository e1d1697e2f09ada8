"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.session import stage


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); nodes of a component share a root.

    Each round hangs every node below its smallest neighbour and contracts the links, so the
    nodes that are left at least halve; it ends when no link is left. Every round is two shuffles of
    what is left, and both tables are written, so a lost executor costs one round at most."""
    left = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                 .filter("a < b").distinct(), "links")
    rounds: list[DataFrame] = []
    while left.head(1):
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("parent")), "parents")
        rounds.append(parent)
        pa, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        left = stage(left.join(pa, "a").join(pb, "b").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .filter("a < b").distinct(), "links")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].toDF("node", "root")
    for parent in rounds[1:]:
        step = parent.toDF("root", "_up")
        out = out.join(step, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    return out
