"""What the two vector operators share: which vectors count, samples for fitting, dealt pairs of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import join_small, materialise


def usable(vec: Column) -> Column:
    """Not null, not empty, not all zero, and every component finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def common_dimension(rows: DataFrame, vec_col: str = "vec") -> int:
    """The length that most vectors have (the smaller of equals); 0 if there are none."""
    top = rows.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return top[0]["d"] if top else 0


def sample_matrix(rows: DataFrame, most: int, id_col: str = "id", vec_col: str = "vec") -> np.ndarray:
    """At most ``most`` vectors, those of the least hashed ids, as a float64 matrix on the driver: a bounded sample to fit on."""
    got = rows.select(F.xxhash64(id_col).alias("h"), id_col, vec_col).orderBy("h", id_col).limit(most).collect()
    return np.array([r[vec_col] for r in got], dtype=np.float64)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def deal_pairs(rows: DataFrame, key: list[str], id_col: str, home_block: int, query_block: int) -> DataFrame:
    """``rows`` with ``__g``: within each key every row with ``home`` true meets every one with ``home`` false in one group.

    Rows of a key that holds more than a block of either side are cut into blocks by a hash; each
    side's row goes to all blocks of the other side. Counts are pre-aggregated. Keys without both
    sides are dropped.
    """
    counts = rows.groupBy(*key).agg(F.count_if("home").alias("nh"), F.count_if(~F.col("home")).alias("nq"))
    blocks = counts.select(*key, F.ceil(F.col("nh") / home_block).cast("int").alias("__nh"), F.ceil(F.col("nq") / query_block).cast("int").alias("__nq"))
    large = materialise(blocks.where("__nh > 1 or __nq > 1"), "pairs-large")
    out = join_small(rows, large, key, "left", salt=F.xxhash64(id_col))
    nh, nq = F.coalesce("__nh", F.lit(1)), F.coalesce("__nq", F.lit(1))
    mine = F.xxhash64(id_col, F.lit("block"))
    own = F.when(F.col("home"), F.pmod(mine, nh)).otherwise(F.pmod(mine, nq)).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("home"), nq).otherwise(nh) - 1)
    out = out.withColumn("__own", own).withColumn("__other", F.explode(others))
    hb, qb = F.when(F.col("home"), F.col("__own")).otherwise(F.col("__other")), F.when(F.col("home"), F.col("__other")).otherwise(F.col("__own"))
    return out.withColumn("__g", F.xxhash64(*key, hb, qb)).drop("__nh", "__nq", "__own", "__other")


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centroids by Lloyd's rule from rows drawn at random; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
