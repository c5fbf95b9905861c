"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u long, v long)``; component is the smallest node reachable.

    Each step keeps connectivity and hangs nodes below smaller ones, until every node points straight at its root.
    All state is in tables: a node with very many neighbours is a partial minimum and a joined key, never a list.
    Loops, null ends and repeated edges are allowed. An empty edge table gives an empty result.
    """
    now = scratch.write(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc-0",
    )
    for k in range(1, max_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the joins' keys are turned over, so that they don't reuse an aggregate's partitions: a hot node's may then be split
        low = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        # large star: every larger neighbour moves to the least of the neighbourhood
        large = both.join(low, F.bitwise_not("u") == F.bitwise_not("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node move to the least of them, and so does the node
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.bitwise_not("u") == F.bitwise_not("k")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.write(small.select("e.u", "e.v").where("u <> v").distinct(), f"cc-{k}")
        scratch.drop(f"cc-{k - 1}")
        now = after
        parents = now.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        open_ = parents.where("n > 1").select(F.col("u")).union(now.join(parents.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"components are still open after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
