"""Near-duplicate embeddings: inverted lists, product-quantised residuals, exact cosine for what they let through."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import materialise, spread
from loomwork.llm.components import connected_components
from loomwork.llm.simhash import group_batches, local_components
from loomwork.llm.vectors import common_dimension, deal_pairs, kmeans, matrix, nearest, sample_matrix, usable

#: Vectors that codebooks are fitted on at most; every vector is indexed.
SAMPLE = 20_000
#: Vectors of one label that a cell is to hold; also the block that larger cells are cut into.
CELL = 2048
#: Centroids of one level; where labels are larger than that many cells, each cell is cut by a second level.
MOST_CENTROIDS = 1024
SUBSPACES = 8


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def half_spaces(x: np.ndarray, centroids: np.ndarray, reach: float) -> np.ndarray:
    """Which centroids' cells can hold a vector within ``reach`` of each row: a vector of a cell lies on its
    side of the plane halfway to the row's own centroid, so the row must be within ``reach`` of that plane."""
    c = centroids
    to = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])
    cell = to.argmin(1)
    apart = np.sqrt(np.maximum(0, (c * c).sum(1)[cell][:, None] - 2 * c[cell] @ c.T + (c * c).sum(1)[None]))
    near = to - to[np.arange(len(x)), cell][:, None] <= 2 * apart * reach + 1e-9
    near[np.arange(len(x)), cell] = True
    return near


class ProductQuantiser:
    """Coarse centroids and, for the residual, a codebook per subspace, fitted on unit vectors.

    More than MOST_CENTROIDS cells have two levels: a cell is a coarse centroid and one of the centroids of what is
    left, so that cells grow with the largest label while both tables stay bounded.
    """

    def __init__(self, sample: np.ndarray, cells: int, subspaces: int = SUBSPACES):
        n, d = sample.shape
        self.coarse = kmeans(sample, min(cells, n, MOST_CENTROIDS))
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.fine = kmeans(rest, min(-(-cells // len(self.coarse)), n, MOST_CENTROIDS), seed=9) if cells > len(self.coarse) else np.zeros((1, d))
        rest = rest - self.fine[nearest(rest, self.fine)]
        self.cuts = np.array_split(np.arange(d), min(subspaces, d))
        self.books = [kmeans(rest[:, c], min(256, max(1, n // 8)), seed=1 + i) for i, c in enumerate(self.cuts)]

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, error): the error is the distance between a vector and what its codes stand for."""
        first = nearest(x, self.coarse)
        cell = first * len(self.fine) + nearest(x - self.coarse[first], self.fine)
        rest = x - self.centre(cell)
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        gap = sum(((rest[:, c] - b[codes[:, m]]) ** 2).sum(1) for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return cell, codes, np.sqrt(gap)

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell that can hold a vector within ``reach`` of a row."""
        i, j = np.nonzero(half_spaces(x, self.coarse, reach))
        if len(self.fine) == 1:
            return i, j
        rows, cells = [], []
        for at in range(0, len(i), 4096):
            a, c = i[at : at + 4096], j[at : at + 4096]
            r, f = np.nonzero(half_spaces(x[a] - self.coarse[c], self.fine, reach))
            rows.append(a[r])
            cells.append(c[r] * len(self.fine) + f)
        return np.concatenate(rows), np.concatenate(cells)

    def tables(self, x: np.ndarray, cell: int) -> list[np.ndarray]:
        """For each subspace the squared distances from x's residual to the codewords."""
        rest = x - self.centre(np.array([cell]))
        return [((rest[:, None, c] - b[None]) ** 2).sum(2) for c, b in zip(self.cuts, self.books, strict=True)]


def cosine_links(rows: DataFrame, threshold: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """Rows (a, n, b) for ``rows`` (id, label, vec): n sums to the links of a; where b isn't null, a and b share a component.

    All pairs of one label with cosine >= ``threshold`` are found: a vector looks into every cell that
    could hold a partner, compares its residual with codes by table lookup, and passes on what the
    triangle inequality allows (code distance <= reach + the code's own error); the cosine decides in
    double precision. Pairs are counted where they are found; what leaves a group of blocks is a count
    per vector and a spanning forest of its links.
    """
    spark = rows.sparkSession
    d = common_dimension(rows)
    rows = rows.where(F.size("vec") == d)
    x = sample_matrix(rows, sample)
    if not len(x):
        return spark.createDataFrame([], "a long, n long, b long")
    most = rows.groupBy("label").count().agg(F.max("count")).first()[0]
    pq = ProductQuantiser(_unit(x), max(1, math.ceil(most / CELL)))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    label, vec = rows.schema["label"].dataType.simpleString(), rows.schema["vec"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(pq)  # at most MOST_CENTROIDS on each level and 256 codewords a subspace

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pq = shared.value
        for b in batches:
            for at in range(0, len(b), 2048):
                y = b.iloc[at : at + 2048]
                if not len(y):
                    continue
                u = _unit(matrix(y["vec"]))
                cell, codes, error = pq.encode(u)
                i, j = pq.probes(u, reach)
                home = y.assign(cell=cell, home=True, codes=[c.tobytes() for c in codes], error=error)
                ask = y.iloc[i].assign(cell=j, home=False, codes=b"", error=0.0)
                yield pd.concat([home, ask], ignore_index=True)

    indexed = rows.select("id", "label", "vec").mapInPandas(index, f"id long, label {label}, vec {vec}, cell int, home boolean, codes binary, error double")
    indexed = materialise(indexed, "pq-index")
    dealt = deal_pairs(indexed, ["label", "cell"], "id", CELL, CELL).select("__g", "id", "vec", "cell", "home", "codes", "error")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pq = shared.value
        for batch in group_batches(batches, 4096):
            for _, g in batch.groupby("__g", sort=False):
                at_home = g["home"].to_numpy(bool)
                home, ask = g[at_home], g[~at_home]
                if not len(home) or not len(ask):
                    continue
                ids, codes = home["id"].to_numpy("i8"), np.frombuffer(b"".join(home["codes"]), np.uint8).reshape(len(home), -1)
                limit = (reach + home["error"].to_numpy() + 1e-9) ** 2
                v, n = _unit(matrix(home["vec"])), np.zeros(len(home), np.int64)
                everyone = np.concatenate([ids, ask["id"].to_numpy("i8")])
                label = np.arange(len(everyone))
                u_all, ask_ids = _unit(matrix(ask["vec"])), ask["id"].to_numpy("i8")
                for q in range(0, len(ask), 256):
                    u = u_all[q : q + 256]
                    near = np.zeros((len(u), len(home)))
                    for m, t in enumerate(pq.tables(u, int(g["cell"].iat[0]))):
                        near += t[:, codes[:, m]]
                    let = near <= limit
                    r, c = np.flatnonzero(let.any(1)), np.flatnonzero(let.any(0))
                    if not len(r):
                        continue
                    ok = (u[r] @ v[c].T >= threshold) & let[np.ix_(r, c)] & (ask_ids[q + r][:, None] != ids[c][None])
                    n[c] += ok.sum(0)
                    i, j = np.nonzero(ok)
                    moved = np.flatnonzero(label != np.arange(len(label)))
                    label = local_components(len(label), np.concatenate([len(home) + q + r[i], moved]), np.concatenate([c[j], label[moved]]))
                linked, moved = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(label)))
                out = pd.DataFrame({"a": np.concatenate([ids[linked], everyone[moved]]), "n": np.concatenate([n[linked], np.zeros(len(moved), np.int64)])})
                out["b"] = pd.array([None] * len(linked) + everyone[label[moved]].tolist(), dtype="Int64")
                yield out

    return spread(dealt, "__g").sortWithinPartitions("__g").mapInPandas(compare, "a long, n long, b long")


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE
) -> DataFrame:
    """Per row of ``vectors``: the id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link when their labels are equal and not null and their cosine is ``threshold`` or more.
    ``component_id`` is the least id reachable, the own one included; ``kept`` says that it is the own.
    Vectors that are null, empty, zero, hold null or non-finite components, or have another length
    than most, link with nothing; nor do rows with a null id, whose ``component_id`` is null and which
    are kept. Rows that repeat an id share the id's links and don't link with each other; a vector's
    links count rows. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    live = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))).withColumn("id", F.col("id").cast("long"))
    found = materialise(cosine_links(live, threshold, sample), "pq-links")
    repeats = materialise(live.groupBy("id").count().where("count > 1"), "pq-repeats")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    counts = counts.join(repeats.withColumnRenamed("id", "a"), "a", "left").select("a", (F.col("n_links") / F.coalesce("count", F.lit(1))).cast("long").alias("n_links"))
    nodes = connected_components(found.where("b is not null").select("a", "b"))
    least = materialise(nodes.groupBy("component").agg(F.min("node").alias("component_id")), "pq-least")
    named = materialise(nodes.join(least, "component").select(F.col("node").alias("a"), "component_id").join(counts, "a", "left"), "pq-components")
    out = vectors.select(F.col(id_col)).join(named, F.col(id_col) == F.col("a"), "left")
    component = F.coalesce("component_id", F.col(id_col))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"))
