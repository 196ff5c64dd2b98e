"""Connected components of an undirected graph by alternating star contractions, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours below a node, and the node, are tied to the least of them. Edges point from ``u`` down to ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs ``u, v``) but the roots: the least node it is connected with.

    Each turn is written to the shared folder, so that a lost executor costs one turn at most; the number of turns grows with
    the logarithm of the longest chain. No edges give no rows; loops are ignored.
    """
    mark = (F.count("*"), F.sum(F.hash("u", "v").cast("long")))
    state = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = tuple(state.agg(*mark).first())
        if seen == before or not seen[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        state = written(_small_star(_large_star(state)), "stars")
