"""Rank association: Kendall's tau by counted inversions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, stored

#: Ranges that each of the two orders is cut into; the histogram of both has at most the square of twice as many cells.
RANGES = 256


def inversions(x: np.ndarray, block: np.ndarray | None = None) -> int:
    """Pairs i < j with x[i] > x[j], and of different ``block`` if that is given; merges of ever longer stretches, each in whole-array steps."""

    def count(v: np.ndarray) -> int:
        total, n, width = 0, len(v), 1
        v = np.unique(v, return_inverse=True)[1].astype(np.int64)
        top = int(v.max()) + 1 if n else 1
        while width < n:
            part = np.arange(n) // (2 * width)
            right = (np.arange(n) // width) % 2 == 1
            key = part * top + v
            keys = key[right]  # ascending: parts follow each other, and each half is sorted
            left = ~right
            below = np.searchsorted(keys, key[left]) - np.searchsorted(keys, part[left] * top)
            total += int(below.sum())
            v = v[np.lexsort((v, part))]
            width *= 2
        return total

    out = count(x)
    if block is not None and len(x):
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        out -= sum(count(s) for s in np.split(x, cuts))
    return out


def _edges(values: DataFrame, name: str) -> list[float]:
    got = values.agg(F.percentile_approx(name, [k / RANGES for k in range(1, RANGES)], F.lit(10 * RANGES)).alias("e")).first()["e"]
    return sorted(set(got or []))


def _range_of(x: str, edges: list[float]) -> Column:
    """Odd for a value that is an edge (a range of its own: a common value always is one), even for what lies between."""
    cuts = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
    return (F.size(F.filter(cuts, lambda e: e < F.col(x))) * 2 + F.exists(cuts, lambda e: e == F.col(x)).cast("int")).cast("int")


def kendall_tau(df: DataFrame, x: str, y: str) -> dict[str, float | int | None]:
    """``n`` complete rows, ``concordant`` and ``discordant`` pairs of them, and ``tau`` (tau-b; None if a column is constant).

    No two rows are joined. Both orders are cut into ranges at approximate quantiles, values that are common by themselves. Pairs
    in different ranges of both orders are counted from the histogram over both; pairs in one range of x inside that
    range, pairs in one of y (and two of x) inside that, by merging: a task holds one range at a time, 1 / 256 of the rows or
    so. Ties come from counts by value.
    """
    require_columns(df, [x, y])
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ex, ey = _edges(rows, "x"), _edges(rows, "y")
    rows = stored(rows.withColumn("a", _range_of("x", ex)).withColumn("b", _range_of("y", ey)))
    cells = rows.groupBy("a", "b").count().collect()  # bounded by the ranges
    n = sum(r["count"] for r in cells)
    grid = np.zeros((2 * len(ex) + 1, 2 * len(ey) + 1), object)
    for r in cells:
        grid[r["a"], r["b"]] = r["count"]
    # of each cell times all cells further along x and lower along y
    across = 0
    below = np.zeros(grid.shape[1], object)
    for row in grid[::-1]:
        upto = np.concatenate([[0], np.cumsum(below)[:-1]]) if len(below) else below
        across += int((row * upto).sum())
        below = below + row

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            g = pd.concat(held, ignore_index=True)
            order = np.lexsort((g["y"], g["x"]))
            v, block = g["y"].to_numpy()[order], g["a"].to_numpy()[order]
            return pd.DataFrame({"d": [inversions(v) if g["k"].iloc[0] == 0 else inversions(v, block)]})

        for b in batches:
            for key, part in b.groupby(["k", "r"], sort=False):
                if held and key != (held[0]["k"].iloc[0], held[0]["r"].iloc[0]):
                    yield flush()
                    held = []
                held.append(part)
        if held:
            yield flush()

    both = rows.select("x", "y", "a", F.inline(F.array(F.struct(F.lit(0).alias("k"), F.col("a").alias("r")), F.struct(F.lit(1).alias("k"), F.col("b").alias("r"))))).where("r % 2 = 0")
    dealt = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "r").sortWithinPartitions("k", "r")
    inside = dealt.mapInPandas(local, "d long").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0]
    pairs = lambda c: F.sum((c.cast("decimal(38,0)") * (c - 1) / 2).cast("decimal(38,0)"))
    ties = {}
    for name, keys in (("x", ["x"]), ("y", ["y"]), ("xy", ["x", "y"])):
        ties[name] = int(rows.groupBy(*keys).count().agg(pairs(F.col("count"))).first()[0] or 0)
    d = across + int(inside or 0)
    total = n * (n - 1) // 2
    c = total - ties["x"] - ties["y"] + ties["xy"] - d
    free = (total - ties["x"]) * (total - ties["y"])
    return {"n": n, "concordant": c, "discordant": d, "tau": (c - d) / float(free) ** 0.5 if free else None}


def kendall_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, concordant, discordant, tau) for each two of ``columns``."""
    rows = [(a, b, *kendall_tau(df, a, b).values()) for a, b in combinations(columns, 2)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, n long, concordant long, discordant long, tau double")


def redundant_by_tau(df: DataFrame, columns: list[str], limit: float) -> list[str]:
    """Columns that a column before them repeats: the absolute tau-b is ``limit`` or more. Constant columns repeat none."""
    out: list[str] = []
    for k, c in enumerate(columns):
        for kept in (b for b in columns[:k] if b not in out):
            tau = kendall_tau(df, kept, c)["tau"]
            if tau is not None and abs(tau) >= limit:
                out.append(c)
                break
    return out
