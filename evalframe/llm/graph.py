"""Connected components of an edge table, by joins and minima; nothing is gathered on the driver but two counts a round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evalframe.llm.shared import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs with the smallest one that they connect it to, where that is another."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(nodes))
    while len(a):
        least = np.minimum(low[one], low[two])
        new = low.copy()
        for at in (one, two, low[one], low[two]):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of `edges` (a long, b long; any order, repeats allowed).

    In every round each neighbour of a node is hung below the smallest node among that node and its neighbours. The rounds
    grow with the logarithm of the longest path; the table never has more than twice as many rows as edges.
    """
    spark = edges.sparkSession
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = written(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("low"))
        hung = both.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = least.select("a", F.col("low").alias("b"))
        edges = written(hung.unionByName(own).where("a > b").distinct(), "edges")
        # done when every node hangs once, below a node that hangs nowhere
        more = edges.groupBy("a").count().where("count > 1").limit(1).count()
        if not more and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            roots = edges.select(F.col("b").alias("node")).distinct()
            return written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))), "components")
