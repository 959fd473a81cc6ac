"""Connected components of an undirected graph by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of ``edges`` (columns ``a`` and ``b``, longs): one row per node that has an edge.

    Returns ``node`` and ``component``, a long that is equal for exactly the nodes of one component
    (not one of the nodes; callers aggregate the name that they want). Loops and repeated edges do no
    harm, null ends are left out, no edges give no rows.

    Each round maps every node to the least of its own and its neighbours' labels, re-hashes the
    labels and drops edges inside a contracted node. Hashing makes the order of the labels random in
    each round, so the number of edges falls geometrically whatever the shape; on one long, 64-bit
    XXH64 is one-to-one, so labels never collide. A hub's minimum is pre-aggregated and every join is
    between two written tables, so adaptive execution can split a hub's rows over tasks.
    """
    pairs = edges.where("a is not null and b is not null and a != b").select("a", "b")
    e = materialise(pairs.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("label", F.xxhash64("node")), "cc-nodes")
    while not e.isEmpty():
        both = e.union(e.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        other = least.select(F.col("u").alias("v"), F.col("m").alias("n"))
        kept = e.join(least, "u").join(other, "v").where("m != n").select(F.xxhash64("m").alias("m"), F.xxhash64("n").alias("n"))
        nodes = materialise(nodes.join(least.withColumnRenamed("u", "label"), "label", "left").select("node", F.xxhash64(F.coalesce("m", "label")).alias("label")), "cc-nodes")
        e = materialise(kept.select(F.least("m", "n").alias("u"), F.greatest("m", "n").alias("v")).distinct(), "cc-edges")
    return nodes.withColumnRenamed("label", "component")
