"""Bounded shortest paths over an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.shared import written


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int = 3) -> DataFrame:
    """Shortest undirected path (src, dst, hops, path) from each source to every node within ``max_hops``.

    ``edges`` has two columns, ``sources`` one. Among equally short paths the one that comes first in name order wins. Only the
    frontier grows: nodes that were reached before are dropped, and each hop is written to the shared folder, so it reads the
    edges once and repeats no earlier hop. The result grows with sources times reachable nodes; a hub is a hot key of a join
    that Spark can split.
    """
    a, b = edges.columns[:2]
    both = written(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a)))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    start = F.col(sources.columns[0])
    frontier = sources.filter(start.isNotNull()).select(start.alias("src"), start.alias("dst"), F.array(start).alias("path")).distinct()
    reached, levels = frontier.select("src", "dst"), []
    for hop in range(1, max_hops + 1):
        grown = frontier.join(both, F.col("dst") == F.col("u")).select("src", F.col("v").alias("dst"), F.concat("path", F.array("v")).alias("path"))
        frontier = written(grown.join(reached, ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier.select("src", "dst"))
        levels.append(frontier.select("src", "dst", F.lit(hop).alias("hops"), "path"))
    if not levels:
        return frontier.select("src", "dst", F.lit(0).alias("hops"), "path")
    return reduce(DataFrame.unionByName, levels)
