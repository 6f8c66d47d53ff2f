"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not its component's smallest.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``.  Large and small stars alternate: every node
    hangs its larger neighbours, then its smaller ones, on the smallest node it knows, until each
    component is one star.  A few rounds over the edges, each written to the shared folder; loops and
    repeated edges do no harm.
    """
    def settled(df: DataFrame) -> bool:
        """Every node either hangs on one other or has others hanging on it."""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            df.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1))).first()[0] == 0

    smaller = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(smaller(edges))
    for _ in range(ROUNDS):
        if settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = written(smaller(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        edges = written(smaller(small))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
