"""Groups of entries that share a bucket and pass a check, without a list of all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch


def linked_groups(members: DataFrame, verified: Callable[[DataFrame], DataFrame], scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of ``members(key long, node long)``: nodes linked by chains of pairs that share a key and that
    ``verified`` keeps of (u, v), u < v, and by the links of ``known(u, v)``. A node without a link may be missing.

    Each bucket's nodes are checked against its least first. Nodes that this doesn't link with it are checked against the
    others of the bucket, but for those that a common neighbour links already. So a bucket of like entries costs its size;
    one of unlike entries costs its square. Buckets of equal content count once.
    """
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = buckets.where("n > 1").groupBy("n", "lo", "x", "y").agg(F.min("key").alias("key")).select("key", "lo")
    once = scratch.write(once, "once")  # a scan, not an aggregate: a hot key's partition may be split in the join
    held = scratch.write(members.join(once, "key"), "held")
    stars = scratch.write(held.where("node <> lo").select(F.col("lo").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    if known is None:
        links = scratch.write(verified(stars), "links-stars")
    else:
        links = scratch.write(verified(stars.join(known, ["u", "v"], "left_anti")).union(known), "links-stars")
    # the least neighbour is a label: two nodes that have the same are linked over it
    labels = scratch.write(links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label")), "labels")
    linked = links.select(F.col("u").alias("lo"), F.col("v").alias("node"), F.lit(True).alias("linked"))
    marked = held.join(labels, "node", "left").join(linked, ["lo", "node"], "left").select("key", "node", F.coalesce("label", "node").alias("label"), (F.col("linked").isNull() & (F.col("node") != F.col("lo"))).alias("open"))
    marked = scratch.write(marked, "marked")
    left = marked.where("open").select("key", "node", "label")
    right = marked.select("key", F.col("node").alias("other"), F.col("label").alias("of"))
    pairs = left.join(right, "key").where("node <> other and label <> of").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    pairs = scratch.write(pairs.join(stars, ["u", "v"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = links.union(scratch.write(verified(pairs), "links-pairs"))
    return connected_components(links, Scratch(members.sparkSession))
