"""Points on a plane or map: centre, nearest neighbours, hull, greatest distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import stored
from loomwork.operators.neighbours import nearest_rows


def centroid(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.avg(x).alias("x"), F.avg(y).alias("y"))


def nearest_points(df: DataFrame, id_col: str, x: str, y: str, cell: float) -> DataFrame:
    """(id, neighbour, distance): the nearest other point within ``cell`` of each point, ties to the smaller id; null beyond.

    Found by ``neighbours.nearest_rows``, whose leaves follow the density of the points: a crowded place costs no more than another.
    Points without x or y are left out; ids must be unique.
    """
    p = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    best = nearest_rows(p, "id", ["x", "y"], 1).where(F.col("d") <= cell).withColumnRenamed("id", "asked")
    return p.select("id").join(best, F.col("id") == F.col("asked"), "left").select(F.col("id").alias(id_col), F.col("o").alias("neighbour"), F.col("d").alias("distance"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest x."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p).reshape(-1, 2)
    sides = []
    for order in (p, p[::-1]):
        side: list[tuple[float, float]] = []
        for q in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]):
                side.pop()
            side.append(q)
        sides += side[:-1]
    return np.array(sides)


def convex_hull(df: DataFrame, x: str, y: str) -> np.ndarray:
    """The hull's corners: each task keeps the corners of its rows, and the hull of those is taken on the driver."""

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, 2))
        for b in batches:
            kept = _hull(np.vstack([kept, b.dropna().to_numpy(float)]))
        yield pd.DataFrame(kept, columns=["x", "y"])

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(corners, "x double, y double").collect()  # corners only
    return _hull(np.array([tuple(r) for r in rows]).reshape(-1, 2))


def greatest_distance(df: DataFrame, x: str, y: str) -> float:
    """The greatest distance between two points: it is between corners of the hull."""
    c = convex_hull(df, x, y)
    return float(max((np.sqrt(((c - p) ** 2).sum(1)).max() for p in c), default=0.0))


def ordered_steps(df: DataFrame, key: str, time_col: str, x: str, y: str) -> DataFrame:
    """``df`` with ``step``, the distance from the same key's point before."""
    w = Window.partitionBy(key).orderBy(time_col)
    return df.withColumn("step", F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)))
