"""Hard negatives by dual-tree search over inner products.

One tree over the anchors, one over the candidates; both are fitted on bounded samples and hold every row. Walking both from
their roots, the interval of inner products that two nodes' balls allow prunes whole groups of anchors against whole
groups of candidates; what is left are pairs of leaves, dealt to tasks and scored exactly in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import join_small, materialise, spread
from loomwork.llm.simhash import group_batches
from loomwork.llm.vectors import common_dimension, deal_pairs, sample_matrix

#: Rows that a tree is fitted on at most.
SAMPLE = 20_000
#: Rows of a leaf that are aimed at, and the greatest depth: a tree has at most 2,047 nodes, and larger leaves are cut into blocks.
CANDIDATE_LEAF, ANCHOR_LEAF, MOST_DEPTH = 2048, 512, 10


@dataclass
class Tree:
    """A complete binary tree: node k splits by ``directions[k] . x >= cuts[k]`` into 2k + 1 and 2k + 2."""

    depth: int
    directions: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.directions[at]) >= self.cuts[at])
        return at


def fit_tree(sample: np.ndarray, n: int, leaf: int) -> Tree:
    """A tree for ``n`` rows: each node's sample is split at the middle of its direction of greatest spread."""
    depth = 0
    while n > leaf << depth and depth < MOST_DEPTH and len(sample) >> depth >= 16:
        depth += 1
    size, d = (2 << depth) - 1, sample.shape[1] if sample.ndim == 2 else 0
    tree = Tree(depth, np.zeros((size, d)), np.zeros(size), np.zeros((size, d)), np.zeros(size), np.zeros(size, np.int64))
    parts = {0: sample}
    for k in range(size):
        x = parts.pop(k)
        tree.centres[k] = x.mean(0) if len(x) else tree.centres[(k - 1) // 2]
        if 2 * k + 1 < size:
            if len(x) > 1:
                y = x - tree.centres[k]
                v = y[np.einsum("ij,ij->i", y, y).argmax()].copy()
                for _ in range(6):  # towards the greatest spread; any direction is right
                    v = y.T @ (y @ v)
                    v /= np.linalg.norm(v) or 1.0
                tree.directions[k] = v
                tree.cuts[k] = np.median(x @ v)
            right = x @ tree.directions[k] >= tree.cuts[k]
            parts[2 * k + 1], parts[2 * k + 2] = x[~right], x[right]
    return tree


def measure(rows: DataFrame, trees: dict[str, Tree], dtype: str) -> None:
    """Set ``radii`` and ``rows`` of all nodes from all rows (``tree``, ``leaf``, ``v``): a partial maximum per task and node, then a row per node."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = {name: np.zeros(len(t.radii)) for name, t in trees.items()}
        count = {name: np.zeros(len(t.radii), np.int64) for name, t in trees.items()}
        for b in batches:
            for name, part in b.groupby("tree"):
                t, at, x = trees[name], part["leaf"].to_numpy("i8"), unpack(part["v"], dtype)
                while True:
                    np.maximum.at(far[name], at, np.linalg.norm(x - t.centres[at], axis=1))
                    np.add.at(count[name], at, 1)
                    if not t.depth or not at.any():
                        break
                    at = (at - 1) // 2
        for name in trees:
            seen = np.flatnonzero(count[name])
            yield pd.DataFrame({"tree": name, "node": seen, "far": far[name][seen], "n": count[name][seen]})

    for r in rows.select("tree", "leaf", "v").mapInPandas(partial, "tree string, node int, far double, n long").groupBy("tree", "node").agg(F.max("far").alias("far"), F.sum("n").alias("n")).collect():  # a row per node
        trees[r["tree"]].radii[r["node"]], trees[r["tree"]].rows[r["node"]] = r["far"], r["n"]


def leaf_pairs(a: Tree, c: Tree, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs (anchor leaf, candidate leaf) that may hold a score from ``least`` to ``most`` (a value per node of ``a``), as rows of two ints.

    Both trees are walked together, a level at a time; a pair of nodes is dropped with all below it if the interval
    of inner products between its balls lies outside of what its anchors look for.
    """
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    norm_a, norm_c = np.linalg.norm(a.centres, axis=1), np.linalg.norm(c.centres, axis=1)
    first_a, first_c = (1 << a.depth) - 1, (1 << c.depth) - 1
    while len(x):
        middle = np.concatenate([np.einsum("ij,ij->i", a.centres[x[i : i + 65536]], c.centres[y[i : i + 65536]]) for i in range(0, len(x), 65536)])
        reach = norm_a[x] * c.radii[y] + norm_c[y] * a.radii[x] + a.radii[x] * c.radii[y]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        stay = (a.rows[x] > 0) & (c.rows[y] > 0) & (middle + reach + slack >= least[x]) & (middle - reach - slack <= most[x])
        x, y = x[stay], y[stay]
        if not len(x) or (x[0] >= first_a and y[0] >= first_c):
            break
        if x[0] < first_a:
            x, y = np.concatenate([2 * x + 1, 2 * x + 2]), np.concatenate([y, y])
        if y[0] < first_c:
            x, y = np.concatenate([x, x]), np.concatenate([2 * y + 1, 2 * y + 2])
    return np.stack([x, y], 1)


def up_tree(tree: Tree, by_leaf: dict[int, float], combine: Callable, empty: float) -> np.ndarray:
    """A value per node, combined from its leaves."""
    out = np.full(len(tree.radii), empty)
    for k, v in by_leaf.items():
        out[k] = v
    for k in range((1 << tree.depth) - 2, -1, -1):
        out[k] = combine(out[2 * k + 1], out[2 * k + 2])
    return out


def unpack(column: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1).astype(np.float64)


def _scored(rows: DataFrame, anchors: DataFrame, pairs: np.ndarray, dtype: str, best: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Score the leaf pairs: ``best(anchors, candidates, scores)`` is called for each block of anchors and of candidates of a pair, candidates in the order of their ids."""
    spark = rows.sparkSession
    p = materialise(spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "c"]), "a int, c int"), "hard-pairs")
    extra = [c for c in anchors.columns if c not in ("leaf", "id", "label", "v")]
    home = join_small(rows.where("tree = 'c'").withColumnRenamed("leaf", "c"), p, ["c"], salt=F.col("id")).select("a", "c", "id", "label", "v", F.lit(True).alias("home"), *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    asks = join_small(anchors.withColumnRenamed("leaf", "a"), p, ["a"], salt=F.col("id")).select("a", "c", "id", "label", "v", F.lit(False).alias("home"), *extra)
    dealt = deal_pairs(home.union(asks), ["a", "c"], "id", CANDIDATE_LEAF, ANCHOR_LEAF)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in group_batches(batches):
            for _, g in x.groupby("__g", sort=False):
                c, q = g[g["home"]], g[~g["home"]]
                if len(c) and len(q):
                    c = c.sort_values(["id", "label"], kind="stable")
                    c = c[~c.duplicated(["id", "label", "v"])]
                    scores = np.rint(np.clip(unpack(q["v"], dtype) @ unpack(c["v"], dtype).T, -9.2e18, 9.2e18)).astype(np.int64)
                    out = best(q, c, scores)
                    if len(out):
                        yield out

    keep = ["__g", "home", "id", "label", "v", *extra]
    return spread(dealt.select(keep), "__g").sortWithinPartitions("__g").mapInPandas(compare, schema)


def _first_of_each(row: np.ndarray, most: int) -> np.ndarray:
    """Of a sorted array of row numbers, which are among the first ``most`` of theirs."""
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row)))) < most


def _positives(k: int) -> Callable:
    def best(q: pd.DataFrame, c: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        same = (q["label"].to_numpy()[:, None] == c["label"].to_numpy()[None]) & (q["id"].to_numpy()[:, None] != c["id"].to_numpy()[None])
        s = np.where(same, scores, np.iinfo(np.int64).min)
        if s.shape[1] > k:
            same &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
        i, j = np.nonzero(same)
        order = np.lexsort((j, -s[i, j], i))  # candidates are in the order of their ids
        i, j = i[order], j[order]
        first = _first_of_each(i, k)
        i, j = i[first], j[first]
        return pd.DataFrame({"anchor": q["id"].to_numpy()[i], "id": c["id"].to_numpy()[j], "score": s[i, j]})

    return best


def bounds_of(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest whole score s with low * positive_score <= 100 * s <= high * positive_score."""
    return -(-low * positive_score // 100), high * positive_score // 100


def _negatives(k: int, low: int, high: int) -> Callable:
    def best(q: pd.DataFrame, c: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        lists = [list(x) for x in q["scores"]]
        width = max(map(len, lists))
        lo, hi = np.full((len(q), width), np.iinfo(np.int64).max), np.full((len(q), width), np.iinfo(np.int64).min)
        for i, ps in enumerate(lists):
            for p, s in enumerate(ps):
                lo[i, p], hi[i, p] = bounds_of(int(s), low, high)
        other = (q["label"].to_numpy()[:, None] != c["label"].to_numpy()[None]) & (q["id"].to_numpy()[:, None] != c["id"].to_numpy()[None])
        i, j = np.nonzero(other & (scores >= lo.min(1)[:, None]) & (scores <= hi.max(1)[:, None]))
        s = scores[i, j]
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        out = []
        for p in range(width):
            fits = np.flatnonzero((s >= lo[i, p]) & (s <= hi[i, p]))
            fits = fits[_first_of_each(i[fits], k)]
            out.append(pd.DataFrame({"anchor": q["id"].to_numpy()[i[fits]], "p": p, "id": c["id"].to_numpy()[j[fits]], "score": s[fits]}))
        return pd.concat(out)

    return best


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor its nearest rows of its label, and for each of them the nearest rows of other labels that score ``low`` to ``high`` percent of it.

    ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``. Vectors hold whole numbers as
    doubles; a score is their inner product, exact below 2^53 and limited to a long's range; higher scores come first, then smaller ids.
    Rows with a null id, label or vector, or with null or non-finite components, take no part, nor do empty vectors and those of
    another length than most. Repeated rows count once; rows that share an id but not label and vector are rows of their own, none of
    them a partner to an anchor of their id, and of anchors that share one the least of label and vector counts. An empty table gives an empty one.
    """
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    good = good.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    dim = common_dimension(good)
    good = good.where((F.size("vec") == dim) & (F.size("vec") > 0))
    sizes = good.agg(F.count("*").alias("n"), F.count_if("anchor").alias("q"), F.max(F.array_max(F.transform("vec", F.abs))).alias("top")).first()
    largest = sizes["top"] or 0.0
    dtype = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    trees = {"c": fit_tree(_sample(good, dim), sizes["n"], CANDIDATE_LEAF), "a": fit_tree(_sample(good.where("anchor"), dim), sizes["q"], ANCHOR_LEAF)}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, np.float64) for v in b["vec"]])
                at = np.where(b["anchor"], trees["a"].leaf(x), trees["c"].leaf(x))
                yield pd.DataFrame({"tree": np.where(b["anchor"], "a", "c"), "leaf": at, "id": b["id"], "label": b["label"], "v": [r.tobytes() for r in x.astype(dtype)]})

    label_type = good.schema["label"].dataType.simpleString()
    both = good.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec", F.lit(True).alias("anchor")).unionByName(good.withColumn("anchor", F.lit(False)))
    placed = materialise(both.mapInPandas(place, f"tree string, leaf int, id long, label {label_type}, v binary"), "hard-rows")
    measure(placed, trees, dtype)
    a, c = trees["a"], trees["c"]
    asked = placed.where("tree = 'a'").drop("tree")

    # a first look into the leaf whose centre suits a group best bounds each anchor's last positive from below
    first_a, first_c = (1 << a.depth) - 1, (1 << c.depth) - 1
    live_a, live_c = first_a + np.flatnonzero(a.rows[first_a:]), first_c + np.flatnonzero(c.rows[first_c:])
    probe = np.stack([live_a, live_c[(a.centres[live_a] @ c.centres[live_c].T).argmax(1)]], 1) if len(live_a) and len(live_c) else np.zeros((0, 2), int)
    found = "anchor long, id long, score long"
    likely = _scored(placed, asked, probe, dtype, _positives(positives), found)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    likely = likely.withColumn("r", F.row_number().over(order)).where(F.col("r") == positives).select(F.col("anchor").alias("id"), F.col("score").cast("double").alias("s"))
    floors = asked.select("id", "leaf").join(likely, "id", "left").groupBy("leaf").agg(F.min(F.coalesce("s", F.lit(float("-inf")))).alias("s")).collect()  # a row per leaf
    least = up_tree(a, {r["leaf"]: r["s"] for r in floors}, min, np.inf)

    near = _scored(placed, asked, leaf_pairs(a, c, least, np.full(len(least), np.inf)), dtype, _positives(positives), found)
    near = materialise(near.withColumn("p", F.row_number().over(order) - 1).where(F.col("p") < positives).select(F.col("anchor").alias("id"), F.struct("p", F.col("id").alias("positive"), "score").alias("x")), "hard-positives")
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most ``positives`` each
    asked = materialise(asked.join(lists, "id").select("leaf", "id", "label", "v", F.col("x.score").alias("scores"), F.col("x.positive").alias("ids")), "hard-anchors")

    # only scores above zero leave room for negatives, or zero for zeros
    wide = asked.select("leaf", F.explode("scores").alias("s")).where("s >= 0").groupBy("leaf").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).collect()  # a row per leaf
    least = up_tree(a, {r["leaf"]: bounds_of(r["lo"], low, high)[0] for r in wide}, min, np.inf)
    most = up_tree(a, {r["leaf"]: bounds_of(r["hi"], low, high)[1] for r in wide}, max, -np.inf)
    hard = _scored(placed, asked.drop("ids"), leaf_pairs(a, c, least, most), dtype, _negatives(negatives, low, high), "anchor long, p int, id long, score long")
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    ranked = ranked.select(F.col("anchor"), "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = ranked.join(asked.select(F.col("id").alias("anchor"), "ids", "scores"), "anchor")
    return out.select(F.col("anchor").alias("anchor_id"), F.get("ids", F.col("p")).alias("positive_id"), "rank", "negative_id", F.get("scores", F.col("p")).alias("positive_score"), "negative_score")


def _sample(rows: DataFrame, dim: int) -> np.ndarray:
    x = sample_matrix(rows, SAMPLE)
    return x if len(x) else np.zeros((0, dim))
