"""Subgraph centrality: a node's closed walks, each weighed by one over the factorial of its length; exact for stated nodes, with an error bound for all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.core import stored
from loomwork.functions.special import chi2_quantile

#: Random vectors that go through the rounds together.
TOGETHER = 64
#: Nodes that one task holds with their random vectors, about.
TASK_NODES = 25_000
#: What ending the series leaves out at most, beside values of one or more: of the exact centralities, and of the estimates.
LEFT_OUT, LEFT_OUT_OF_ESTIMATES = 1e-10, 1e-4


def _both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; the edges, which may be costly, are worked out once."""
    return stored(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))


def radius_bound(edges: DataFrame, rounds: int = 6) -> float:
    """A number that no eigenvalue of the adjacency matrix exceeds: for any positive vector the largest ratio of a node's neighbours' sum to its own value.

    The vector starts as ones and takes ``rounds`` of power iteration (a node keeps its own value too, so that it stays positive).
    """
    return _radius(_both_ways(edges), rounds)


def _radius(both: DataFrame, rounds: int = 6) -> float:
    x = stored(both.select(F.col("a").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    least = math.inf
    for _ in range(rounds):
        near = both.join(x.withColumnsRenamed({"node": "b", "x": "y"}), "b").groupBy("a").agg(F.sum("y").alias("s"))
        new = stored(x.join(near, x["node"] == near["a"]).select("node", "x", "s"))
        top = new.agg(F.max(F.col("s") / F.col("x")).alias("ratio"), F.max(F.col("x") + F.col("s")).alias("size")).first()
        if top["ratio"] is None:
            return 0.0
        least = min(least, top["ratio"])
        x = new.select("node", ((F.col("x") + F.col("s")) / F.lit(top["size"])).alias("x"))
    return float(least)


def _terms(radius: float, left_out: float = LEFT_OUT) -> int:
    """Terms of the exponential's series after which less than ``left_out`` is missing in the square of half the exponential."""
    r = radius / 2
    if r > 345:
        raise ValueError("the centralities are too large for doubles")
    term, m = 1.0, 0
    while term * math.exp(r) * 2 > left_out or m < r:
        m += 1
        term *= r / m
        if m > 5000:
            break
    return m + 1


def subgraph_centrality(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, centrality) of each of a bounded set of nodes (column ``node``): the diagonal of the exponential of the adjacency matrix.

    It is the squared length of half the exponential applied to the node's own vector; a round for each term of the series (from the last one inwards), all
    sources at once, as rows (source, node). Rounds grow with ``radius_bound``. A source without edges has centrality 1; null sources are left out.
    """
    both = _both_ways(edges)
    terms = _terms(_radius(both))
    own = stored(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("x")).where("node is not null").distinct())
    total = own
    for m in range(terms, 0, -1):  # from the last term inwards: own + A (own + A (...) / 4) / 2
        walked = total.join(both, total["node"] == both["a"]).select("source", F.col("b").alias("node"), (F.col("x") / (2.0 * m)).alias("x"))
        total = stored(own.unionByName(walked).groupBy("source", "node").agg(F.sum("x").alias("x")))
    return total.groupBy(F.col("source").alias("node")).agg(F.sum(F.col("x") * F.col("x")).alias("centrality"))


def estimated_subgraph_centrality(edges: DataFrame, probes: int = 64, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """(node, centrality, low, high) of every node with an edge: unbiased estimates, each between its bounds with the chance ``confidence``.

    Half the exponential is applied to ``probes`` vectors of independent normal numbers (a hash of node and probe, so that reruns agree). At a node
    each result is normal with the node's centrality as its variance; so the mean of the squares, divided by the centrality, is chi-squared over
    ``probes``, on any graph: its quantiles are the bounds, and the relative deviation is sqrt(2 / probes). A row per node with 64 numbers goes through the rounds,
    in tasks whose number grows with the nodes.
    """
    if probes < 1:
        raise ValueError("at least one probe")
    both = _both_ways(edges)
    terms = _terms(_radius(both), LEFT_OUT_OF_ESTIMATES)
    nodes = stored(both.select(F.col("a").alias("node")).distinct())
    tasks = max(1, -(-nodes.count() // TASK_NODES))
    many = tasks > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fewer are dealt by Spark itself
    dealt = lambda d, end: d.repartition(tasks, end) if many else d
    squares = None
    unit = lambda *key: (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    for start in range(0, probes, TOGETHER):
        names = [f"x{i}" for i in range(min(TOGETHER, probes - start))]
        draw = [(F.sqrt(-2 * F.log(unit(F.col("node"), F.lit(start + i), F.lit(2 * seed)))) * F.cos(2 * math.pi * unit(F.col("node"), F.lit(start + i), F.lit(2 * seed + 1)))) for i in range(len(names))]
        own = stored(nodes.repartition(tasks, "node").select("node", *[z.alias(x) for x, z in zip(names, draw, strict=True)]))
        total = own.withColumn("m", F.lit(float(terms)))
        for _ in range(terms):  # as above; m is a column, so that all rounds run the same generated code
            walked = dealt(both, "b").join(dealt(total.withColumnRenamed("node", "b"), "b"), "b")
            near = dealt(walked, "a").groupBy("a").agg(F.first("m").alias("m"), *[F.sum(x).alias(f"y{x}") for x in names])
            total = stored(dealt(own, "node").join(near, own["node"] == near["a"]).select("node", *[(F.col(x) + F.col(f"y{x}") / (2 * F.col("m"))).alias(x) for x in names], (F.col("m") - 1).alias("m")))
        here = total.select("node", sum((F.col(x) * F.col(x) for x in names), F.lit(0.0)).alias("s"))
        squares = here if squares is None else stored(squares.unionByName(here).groupBy("node").agg(F.sum("s").alias("s")))
    low, high = (chi2_quantile(p, probes) for p in ((1 + confidence) / 2, (1 - confidence) / 2))
    return squares.select("node", (F.col("s") / probes).alias("centrality"), F.greatest(F.lit(1.0), F.col("s") / low).alias("low"), F.greatest(F.lit(1.0), F.col("s") / high).alias("high"))
