"""Triangles by triples of node ranges: a task has the edges between three ranges, and what is shuffled grows with the edges, not with the paths of two edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.core import stored
from loomwork.functions.ordered import numbered

#: About so many edges go to a task where edges join all ranges alike.
TASK_EDGES = 1_000_000
#: Edges that are packed together; cells of a table of neighbours that a task looks into, and paths of two edges that it follows at a time.
PACKED, LOOKED, PATHS = 1 << 19, 1 << 20, 1 << 16
#: Spans whose rows are counted to cut the nodes into ranges, and tasks at most that triples of ranges are dealt to.
BUCKETS, MOST_TASKS = 1 << 14, 2000


def _found(a: np.ndarray, b: np.ndarray, part: np.ndarray, want: tuple[int, int, int]) -> np.ndarray:
    """Triangles at each of the nodes 0... of the edges (a, b) whose nodes' ranges are ``want``, in order. Edges point to the higher degree, which bounds the paths at hubs.

    The table of neighbours and the paths of a step are small enough for a core's cache: tasks side by side don't wait for memory.
    """
    n = len(part)
    order = np.argsort(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    x, y = rank[a], rank[b]
    key = np.sort(np.minimum(x, y) * n + np.maximum(x, y))
    u, v = (key // n).astype(np.int32), (key % n).astype(np.int32)
    starts = np.searchsorted(u, np.arange(n + 1))
    out = np.diff(starts)
    before = np.append(0, np.cumsum(out[v]))[starts]
    part, found, low = part[order], np.zeros(n, np.int64), 0
    mixed, want_row = part[0] != part[-1] or (part != part[0]).any(), np.array(want)[:, None]
    near = np.zeros(n, bool)
    while low < n:
        high = min(n, low + max(1, LOOKED // n), max(low + 1, int(np.searchsorted(before, before[low] + PATHS, "right")) - 1))
        edges = slice(starts[low], starts[high])
        uu, vv, count = u[edges], v[edges], out[v[edges]]
        if before[high] > before[low]:
            near = np.zeros((high - low) * n, bool) if len(near) < (high - low) * n else near
            row = (uu - low).astype(np.int64) * n
            near[row + vv] = True
            ends = np.cumsum(count)
            w = v[np.repeat(starts[vv] - (ends - count), count) + np.arange(ends[-1])]
            hit = np.flatnonzero(near[np.repeat(row, count) + w])
            near[row + vv] = False
            edge = np.searchsorted(ends, hit, "right")
            t = np.stack([uu[edge], vv[edge], w[hit]])
            if mixed:
                t = t[:, (np.sort(part[t], axis=0) == want_row).all(axis=0)]
            np.add.at(found, t.ravel(), 1)
        low = high
    return found[rank]


def _renumbered(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes in order, and the edges by their places."""
    low, span = int(ends.min()), int(ends.max()) - int(ends.min()) + 1
    if span > 4 * len(ends):
        nodes, at = np.unique(ends, return_inverse=True)
        return nodes, at.reshape(-1, 2)
    used = np.zeros(span, bool)
    used[ends - low] = True
    return np.flatnonzero(used) + low, (np.cumsum(used) - 1)[ends - low].reshape(-1, 2)


def _useful(at: np.ndarray, part: np.ndarray, want: tuple[int, int, int]) -> np.ndarray:
    """Whether both ends of an edge have edges into the third of the ranges ``want``: others are in no triangle of it."""
    a, b = part[at[:, 0]], part[at[:, 1]]
    third = sum(int(k) for k in want) - a - b
    keep = np.zeros(len(at), bool)
    for r in {int(k) for k in want}:
        beside = np.zeros(len(part), bool)
        beside[at[b == r, 0]] = True
        beside[at[a == r, 1]] = True
        keep |= (third == r) & beside[at[:, 0]] & beside[at[:, 1]]
    return keep


def _cuts(ends: DataFrame, p: int) -> np.ndarray:
    """Starts of the ranges after the first, of about equal numbers of rows: by counts of ``BUCKETS`` equal spans of the numbers, or by approximate ranks where the numbers lie too unevenly for that."""
    low, high = ends.agg(F.min("node"), F.max("node")).first()
    span = (int(high) - int(low)) // BUCKETS + 1
    rows = ends.groupBy(F.floor((F.col("node").cast("decimal(20,0)") - int(low)) / span).cast("long").alias("k") if span > 1 << 40 else F.expr(f"(CAST(node AS BIGINT) - {int(low)}L) DIV {span}L").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()  # a row a span
    k, n = np.array([[r["k"], r["n"]] for r in rows], np.int64).T
    if n.max() > n.sum() / p / 2 and span > 1:
        return np.array(sorted(set(ends.agg(F.percentile_approx("node", [i / p for i in range(1, p)], 10_000)).first()[0])), np.int64)
    at = np.searchsorted(np.cumsum(n), [n.sum() * i / p for i in range(1, p)], "left")
    return np.unique(k[at] * span + int(low))


def triangle_counts(edges: DataFrame, written: bool = False) -> DataFrame:
    """(node, triangles) of the nodes in any; ``edges`` (a, b) are distinct and undirected, and worked out once unless they are a ``written`` table.

    Nodes are cut into ranges of about equal degree sums. An edge goes to each triple of ranges that has both of its ends and edges
    between all three: at most as many as there are ranges (which grow with the root of the edges), few if most edges lie inside ranges.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    e, ids = edges.where("a != b").select("a", "b"), None
    e = e if written else stored(e)
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        ids = stored(numbered(e.select(F.explode(F.array("a", "b")).alias("name")).distinct(), ["name"], "id"))
        e = stored(e.join(ids.withColumnsRenamed({"name": "a", "id": "x"}), "a").join(ids.withColumnsRenamed({"name": "b", "id": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    p = max(1, math.ceil(math.sqrt(6 * e.count() / TASK_EDGES)))
    ends = e.select(F.explode(F.array("a", "b")).alias("node"))
    cuts = _cuts(ends, p) if p > 1 else np.zeros(0, np.int64)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cells(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, b = (np.concatenate([h[c].to_numpy(np.int64) for h in held]) for c in ("a", "b"))
            d = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
            k = np.searchsorted(cuts, d[:, 0], "right") * (len(cuts) + 1) + np.searchsorted(cuts, d[:, 1], "right")
            order = np.argsort(k, kind="stable")
            d, k = d[order], k[order]
            first = np.flatnonzero(np.diff(k, prepend=-1))
            for low, high in zip(first, np.append(first[1:], len(k)), strict=True):
                yield pd.DataFrame({"x": [k[low] // (len(cuts) + 1)], "y": [k[low] % (len(cuts) + 1)], "ends": [d[low:high].tobytes()]})

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= PACKED:
                yield from cells(held)
                held, rows = [], 0
        if rows:
            yield from cells(held)

    packed = stored(e.mapInPandas(pack, "x int, y int, ends binary"))
    used = {(r["x"], r["y"]) for r in packed.select("x", "y").distinct().collect()}  # at most a row for two ranges
    beside = {x: sorted(y for z, y in used if z == x) for x, _ in used}
    triples = [(i, j, k) for i in beside for j in beside[i] for k in beside[i] if j <= k and (j, k) in used]
    if not triples:
        return spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("triangles", T.LongType())]))
    sent = [(x, y, i, j, k) for i, j, k in triples for x, y in {(i, j), (i, k), (j, k)}]
    to = spark.createDataFrame(pd.DataFrame(sent, columns=["x", "y", "i", "j", "k"]).astype("int32"))

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, at = _renumbered(np.frombuffer(b"".join(rows["ends"]), np.int64))
        part = np.searchsorted(cuts, nodes, "right")
        at = at[_useful(at, part, key)]
        n = _found(at[:, 0], at[:, 1], part, tuple(int(k) for k in key)) if len(at) else np.zeros(len(nodes), np.int64)
        return pd.DataFrame({"node": nodes[n > 0], "triangles": n[n > 0]})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * len(triples), MOST_TASKS))  # with fewer, some would get several triples and others none
    t = packed.join(F.broadcast(to), ["x", "y"]).select("i", "j", "k", "ends").repartition(tasks, "i", "j", "k").groupBy("i", "j", "k").applyInPandas(count, "node long, triangles long")
    t = t.groupBy("node").agg(F.sum("triangles").alias("triangles"))
    if ids is not None:
        return t.join(ids, t["node"] == ids["id"]).select(F.col("name").alias("node"), "triangles")
    return t.select(F.col("node").cast(kind).alias("node"), "triangles")
