"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written


EDGES_A_FILE = 200_000


def _state(edges: DataFrame) -> tuple:
    """How many edges there are, and which."""
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached, for every node of the edges (a, b: long).

    Edges are rewired to ever smaller neighbours, by turns over larger and over smaller neighbours, until each node hangs on its
    component's smallest. A round joins edges with one minimum a node, so a node of very high degree is a hot key of a join that
    Spark can split, never a group. Each round is written, in as many files as its edges need, and about log(diameter) rounds
    are needed.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(current)
    while True:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = written(small.select("e.*").where("u <> v").distinct().coalesce(state[0] // EDGES_A_FILE + 1))  # rounds add no edges
        now = _state(current)
        if now == state:
            break
        state = now
    hung = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return hung.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
