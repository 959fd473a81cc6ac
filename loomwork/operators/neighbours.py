"""Exact nearest rows by Euclidean distance: leaves of a tree, bounds to their boxes, blocks compared in tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, stored

#: Points that the tree is fitted on at most; a leaf's aim; the tree's greatest depth. What a task compares is a block against a block.
SAMPLE, LEAF, MOST_DEPTH, BLOCK = 50_000, 1024, 12, 1024
#: So few points are one leaf.
LAST_ROWS = 1024


def fit_splits(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(dimension, cut of each inner node, depth) of a tree over a sample of ``n`` points: each node is cut at the middle of its widest dimension."""
    depth = 0
    while n > LAST_ROWS and n > LEAF << depth and depth < MOST_DEPTH and len(x) >> depth >= 16:
        depth += 1
    dims, cuts, parts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), {0: x}
    for k in range((1 << depth) - 1):
        y = parts.pop(k)
        if len(y):
            dims[k] = np.ptp(y, axis=0).argmax()
            cuts[k] = np.median(y[:, dims[k]])
        right = y[:, dims[k]] >= cuts[k]
        parts[2 * k + 1], parts[2 * k + 2] = y[~right], y[right]
    return dims, cuts, depth


def leaf_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + (x[np.arange(len(x)), dims[at]] >= cuts[at])
    return at - ((1 << depth) - 1)


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of batches that are sorted by ``key``."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for g, part in b.groupby(key, sort=False):
            if held and held[0][key].iloc[0] != g:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _closest(queries: DataFrame, homes: DataFrame, xs: Sequence[str], k: int) -> DataFrame:
    """(p, q, d): for each query (p, xs, leaf, block) and each block of points (q, xs, leaf, block) with its leaf and block, its ``k`` nearest other points there and all that tie with the last."""
    both = homes.select("leaf", "block", F.col("q").alias("p"), *xs, F.lit(True).alias("home"), F.lit(0).alias("cut"))
    counts = queries.groupBy("leaf", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))  # more queries than a block holds are cut too
    asked = queries.join(counts, ["leaf", "block"]).select("leaf", "block", "p", *xs, F.lit(False).alias("home"), F.pmod(F.xxhash64("p", F.lit("cut")), "cuts").cast("int").alias("cut"))
    spread = both.join(counts, ["leaf", "block"]).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(asked.columns)
    rows = asked.union(spread).withColumn("g", F.xxhash64("leaf", "block", "cut"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _grouped(batches, "g"):
            h, q = x[x["home"]], x[~x["home"]]
            if not len(h) or not len(q):
                continue
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                d = np.zeros((len(part), len(h)))
                for c in xs:  # in the order of the columns, as a sum of plain expressions is
                    d += (part[c].to_numpy()[:, None] - h[c].to_numpy()[None]) ** 2
                d = np.sqrt(d)
                d[part["p"].to_numpy()[:, None] == h["p"].to_numpy()[None]] = np.inf
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(part), np.finfo(float).max)
                i, j = np.nonzero((d <= last[:, None]) & (d < np.inf))
                yield pd.DataFrame({"p": part["p"].to_numpy()[i], "q": h["p"].to_numpy()[j], "d": d[i, j]})

    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g").mapInPandas(compare, "p long, q long, d double")


def nearest_points(points: DataFrame, xs: Sequence[str], k: int) -> DataFrame:
    """(p, q, d): the ``k`` nearest other points of each point (``p``, a long, and ``xs``; no two alike), and all that tie with the k-th.

    A tree of at most 4,096 leaves is fitted on at most 50,000 points and holds all of them; leaves over 1,024 points are cut into blocks by a
    hash. Each point is held against its own block first: its k-th neighbour there bounds how far away a nearer one can be. Then it
    goes to the leaves whose boxes reach into that distance, and to no other. Nothing is joined but rows of one leaf and block; in
    few dimensions that is a handful of leaves, in many most of them. Beyond some four million points leaves grow with the table.
    """
    n = points.count()
    sample = np.array([tuple(r) for r in points.select(*xs).orderBy(F.xxhash64("p")).limit(SAMPLE).collect()], dtype=np.float64).reshape(-1, len(xs))
    dims, cuts, depth = fit_splits(sample, n)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["leaf"] = leaf_of(b[list(xs)].to_numpy(np.float64), dims, cuts, depth).astype(np.int32)
            yield b

    columns = ", ".join(f"{x} double" for x in xs)
    placed = stored(points.select("p", *xs).mapInPandas(place, f"p long, {columns}, leaf int"))
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.min(x).alias(f"a{x}") for x in xs], *[F.max(x).alias(f"b{x}") for x in xs]).orderBy("leaf").toPandas()  # a row per leaf
    blocks = {int(l): -(-int(m) // BLOCK) for l, m in zip(boxes["leaf"], boxes["n"])}
    leaves, low, high = boxes["leaf"].to_numpy(), boxes[[f"a{x}" for x in xs]].to_numpy(), boxes[[f"b{x}" for x in xs]].to_numpy()
    sizes = points.sparkSession.createDataFrame([(l, b) for l, b in blocks.items()], "leaf int, blocks int")
    homes = stored(placed.join(F.broadcast(sizes), "leaf").select(F.col("p").alias("q"), *xs, "leaf", F.pmod(F.xxhash64("p"), "blocks").cast("int").alias("block")))  # a row per leaf
    first = stored(_closest(homes.withColumnRenamed("q", "p"), homes, xs, k))
    reach = first.groupBy("p").agg(F.count(F.lit(1)).alias("m"), F.array_sort(F.collect_list("d")).alias("d"))  # k and ties of one block
    known = homes.withColumnRenamed("q", "p").join(reach.select("p", F.when(F.col("m") >= k, F.get("d", F.lit(k - 1))).alias("reach")), "p", "left")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.array([blocks[int(l)] for l in leaves])
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                x, r = part[list(xs)].to_numpy(np.float64), part["reach"].to_numpy(np.float64, na_value=np.inf)
                off = np.zeros((len(part), len(leaves)))
                for i in range(len(xs)):
                    off += np.maximum(0, np.maximum(low[None, :, i] - x[:, None, i], x[:, None, i] - high[None, :, i])) ** 2
                i, l = np.nonzero(np.sqrt(off) * (1 - 1e-12) <= r[:, None])
                rows, l = np.repeat(i, number[l]), np.repeat(l, number[l])
                start = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (l[1:] != l[:-1])])) if len(rows) else np.zeros(0, np.int64)
                block = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
                own = (leaves[l] == part["leaf"].to_numpy()[rows]) & (block == part["block"].to_numpy()[rows])
                rows, l, block = rows[~own], l[~own], block[~own]
                out = part.iloc[rows][["p", *xs]].reset_index(drop=True)
                out["leaf"], out["block"] = leaves[l].astype(np.int32), block.astype(np.int32)
                yield out

    # written: the queries are counted and then compared
    wide = stored(known.mapInPandas(look, f"p long, {columns}, leaf int, block int"))
    found = first.union(_closest(wide, homes, xs, k))
    return found.withColumn("r", F.rank().over(Window.partitionBy("p").orderBy("d"))).where(F.col("r") <= k).drop("r")


def nearest_rows(df: DataFrame, id_col: str, columns: Sequence[str], k: int, ties: bool = False) -> DataFrame:
    """(id, o, d): the k nearest other rows of each complete row, all that tie with the k-th (``ties``) or the least ids of these.

    Rows with equal values are one point with its k + 1 least ids, so a value that many rows share costs no pairs among them
    (but for ``ties``, which asks for them). Points are found by ``nearest_points``. Null and NaN values make a row incomplete. Ids must be
    unique; fewer than k other rows give all of them.
    """
    require_columns(df, [id_col, *columns])
    xs = [f"x{i}" for i in range(len(columns))]
    rows = df.select(F.col(id_col).alias("id"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0)).alias(x) for c, x in zip(columns, xs, strict=True)]).dropna()
    rows = stored(rows.withColumn("p", F.xxhash64(*xs)))
    ids = rows.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("id"))).where(F.col("r") <= k + 1)
    points = stored(ids.groupBy("p").agg(*[F.min(x).alias(x) for x in xs], F.array_sort(F.collect_list("id")).alias("ids")))  # k + 1 at most
    near = stored(nearest_points(points, xs, k))
    own = points.select("p", F.col("p").alias("q"), F.lit(0.0).alias("d"))
    if ties:
        # members of the points: the k-th distance of a row counts the other rows of its own point too
        members = rows.groupBy("p").agg(F.count(F.lit(1)).alias("m"))
        sized = near.union(own).join(members.withColumnsRenamed({"p": "q", "m": "n"}), "q")
        upto = F.sum("n").over(Window.partitionBy("p").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - 1  # all but the row itself
        inside = sized.withColumn("upto", upto).withColumn("tied", F.sum("n").over(Window.partitionBy("p", "d"))).where((F.col("upto") - F.col("tied") + F.when(F.col("d") == 0, 1).otherwise(0)) < k)
        pairs = inside.select("p", "q", "d").join(rows.select("p", "id"), "p").join(rows.select(F.col("p").alias("q"), F.col("id").alias("o")), "q")
        return pairs.where("id != o").select("id", "o", "d")
    listed = near.union(own).join(points.select(F.col("p").alias("q"), "ids"), "q").select("p", "d", F.explode("ids").alias("o"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("d", "o"))).where(F.col("r") <= k + 1)
    lists = listed.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("d", "o"))).alias("x"))  # k + 1 at most
    first = F.slice(F.filter("x", lambda v: v["o"] != F.col("id")), 1, k)
    return rows.join(lists, "p").select("id", F.explode(first).alias("v")).select("id", F.col("v.o").alias("o"), F.col("v.d").alias("d"))
