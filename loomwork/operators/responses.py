"""Item response models: graded responses (two levels give the two-parameter model) by marginal likelihood, and persons' abilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, stored

#: Items, and levels of all items together, at most: a task holds a row per level and node.
MOST_ITEMS, MOST_ITEM_LEVELS = 200, 4000
#: Points of the ability scale, and a task's patterns at a time.
NODES, BATCH = np.linspace(-6, 6, 61), 2000


@dataclass
class ResponseFit:
    """Each item's levels, slope and intercepts (a level or more is reached with the logistic of slope times ability plus intercept); the log-likelihood before each round and at the end."""

    items: list
    levels: list[list]
    slopes: np.ndarray
    intercepts: list[np.ndarray]
    rounds: list[float] = field(default_factory=list)

    def table(self) -> list[tuple]:
        """(item, level, discrimination, intercept, difficulty) of each level but the lowest."""
        return [(j, v, float(a), float(d), float(-d / a) if a else None) for j, vs, a, ds in zip(self.items, self.levels, self.slopes, self.intercepts, strict=True) for v, d in zip(vs[1:], ds, strict=True)]


def _item_levels(df: DataFrame, item: str, response: str) -> tuple[list, list[list]]:
    found = df.groupBy(item, response).agg(F.count(F.lit(1)).alias("n")).limit(MOST_ITEM_LEVELS + 1).collect()
    if len(found) > MOST_ITEM_LEVELS:
        raise ValueError(f"more than {MOST_ITEM_LEVELS} levels of items")
    of: dict = {}
    for r in found:
        of.setdefault(r[0], []).append(r[1])
    items = sorted(j for j, vs in of.items() if len(vs) > 1)
    if len(items) < 2:
        raise ValueError("fewer than two items with more than one level")
    if len(items) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items")
    return items, [sorted(of[j]) for j in items]


def response_patterns(df: DataFrame, person: str, item: str, response: str, items: list, levels: list[list]) -> DataFrame:
    """(person, pattern): the number of the level of each item in turn, -1 where a person has none; the highest of several responses."""
    spark = df.sparkSession
    index = spark.createDataFrame([(j, v, i, k) for i, (j, vs) in enumerate(zip(items, levels, strict=True)) for k, v in enumerate(vs)], f"__j {df.schema[item].dataType.simpleString()}, __v {df.schema[response].dataType.simpleString()}, i int, k int")
    known = df.select(F.col(person).alias("person"), F.col(item).alias("__j"), F.col(response).alias("__v")).where("person is not null").join(F.broadcast(index), ["__j", "__v"])  # at most MOST_ITEM_LEVELS rows
    each = known.groupBy("person", "i").agg(F.max("k").alias("k")).groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("i", "k"))).alias("m"))  # at most a response per item
    return each.select("person", F.transform(F.sequence(F.lit(0), F.lit(len(items) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1))).alias("pattern"))


def _reached(slope: float, intercepts: np.ndarray) -> np.ndarray:
    """The chance at each node that a level or more is reached; 1 for the lowest, 0 beyond the highest."""
    p = 1 / (1 + np.exp(-np.clip(slope * NODES + intercepts[:, None], -700, 700)))
    return np.vstack([np.ones(len(NODES)), p, np.zeros(len(NODES))])


def _log_levels(slopes: np.ndarray, intercepts: list[np.ndarray]) -> np.ndarray:
    """Items by levels by nodes; the last level, of a missing response, is certain."""
    most = max(len(d) for d in intercepts) + 1
    out = np.zeros((len(slopes), most + 1, len(NODES)))
    for i, (a, d) in enumerate(zip(slopes, intercepts, strict=True)):
        out[i, : len(d) + 1] = np.log(np.maximum(-np.diff(_reached(a, d), axis=0), 1e-300))
    return out


def _weights() -> np.ndarray:
    w = np.exp(-NODES**2 / 2)
    return w / w.sum()


def _posterior(patterns: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood, weights of the nodes) of each pattern."""
    total = np.broadcast_to(np.log(_weights()), (len(patterns), len(NODES))).copy()
    for i in range(patterns.shape[1]):
        total += logs[i, patterns[:, i]]
    top = total.max(1, keepdims=True)
    w = np.exp(total - top)
    s = w.sum(1, keepdims=True)
    return (top + np.log(s))[:, 0], w / s


def _expected(batches: Iterator[pd.DataFrame], slopes: np.ndarray, intercepts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """The log-likelihood of this task's patterns and the expected numbers of persons by item, level and node."""
    logs = _log_levels(slopes, intercepts)
    counts, ll = np.zeros(logs.shape), 0.0
    for d in batches:
        for at in range(0, len(d), BATCH):
            patterns, n = np.stack(d["pattern"].iloc[at : at + BATCH].to_list()), d["n"].iloc[at : at + BATCH].to_numpy(dtype=float)
            own, w = _posterior(patterns, logs)
            ll += float(own @ n)
            w *= n[:, None]
            for k in range(logs.shape[1] - 1):
                counts[:, k] += (patterns == k).T.astype(float) @ w
    yield pd.DataFrame({"ll": [ll], "s": [counts.ravel()]})


def _item_step(slope: float, intercepts: np.ndarray, r: np.ndarray, steps: int = 5) -> tuple[float, np.ndarray]:
    """A few scoring steps of one item's parameters on its expected counts (levels by nodes); a step is halved until the fit is no worse."""
    k = len(intercepts)

    def value(x: np.ndarray) -> float:
        p = -np.diff(_reached(x[0], x[1:]), axis=0)
        return -np.inf if (p <= 0).any() else float((r * np.log(p)).sum())

    x = np.concatenate([[slope], intercepts])
    now = value(x)
    for _ in range(steps):
        s = _reached(x[0], x[1:])
        w, p = s * (1 - s), -np.diff(s, axis=0)
        grads = np.zeros((k + 1, k + 1, len(NODES)))  # parameter, level, node
        grads[0] = -np.diff(w * NODES, axis=0)
        for j in range(k):
            grads[j + 1, j + 1] += w[j + 1]
            grads[j + 1, j] -= w[j + 1]
        g = (grads * (r / p)).sum((1, 2))
        info = np.einsum("akq,bkq->ab", grads * (r.sum(0) / p), grads)
        step, size = np.linalg.solve(info + 1e-9 * np.trace(info) * np.eye(k + 1), g), 1.0
        while size > 1e-6 and not value(x + size * step) >= now:
            size /= 2
        if size <= 1e-6:
            break
        x = x + size * step
        now = value(x)
        if np.abs(size * step).max() < 1e-10:
            break
    return float(x[0]), x[1:]


def graded_responses(df: DataFrame, person: str, item: str, response: str, tolerance: float = 1e-4, most_rounds: int = 500) -> ResponseFit:
    """A slope and an intercept per level of each item, from rows (person, item, response), by marginal likelihood over normal abilities.

    Persons with the same pattern of responses are one row with a count. A round of expectation-maximisation is one pass over the patterns: each task adds up
    the chances of 61 abilities into expected counts by item, level and node, and the few parameters of an item are fitted to those. The likelihood never falls. Rounds end when no
    parameter moves by more than ``tolerance``, or after ``most_rounds``. Missing responses say nothing; rows with nulls and items of one level are left out. The slopes' common sign is set so that their sum isn't negative.
    Raises ValueError for fewer than two items, more than 200, or more than 4,000 levels.
    """
    require_columns(df, [person, item, response])
    rows = df.select(person, item, response).where(F.col(person).isNotNull() & F.col(item).isNotNull() & F.col(response).isNotNull())
    items, levels = _item_levels(rows, item, response)
    table = stored(response_patterns(rows, person, item, response, items, levels).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    shares = table.select("n", F.posexplode("pattern").alias("i", "k")).groupBy("i", "k").agg(F.sum("n").alias("n")).collect()  # a row per level
    slopes, intercepts = np.ones(len(items)), []
    for i, vs in enumerate(levels):
        n = np.array([next((r["n"] for r in shares if (r["i"], r["k"]) == (i, k)), 0.5) for k in range(len(vs))], dtype=float)
        above = np.clip(1 - np.cumsum(n)[:-1] / n.sum(), 1e-6, 1 - 1e-6)
        intercepts.append(np.log(above / (1 - above)) * 1.2 - 1e-6 * np.arange(len(above)))
    fit = ResponseFit(items, levels, slopes, intercepts)
    shape = _log_levels(slopes, intercepts).shape
    for _ in range(most_rounds):
        a, d = fit.slopes, fit.intercepts
        parts = table.mapInPandas(lambda it, a=a, d=d: _expected(it, a, d), "ll double, s array<double>")
        got = parts.select("ll", F.posexplode("s").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"), F.sum("ll").alias("ll")).orderBy("j").toPandas()  # a row per item, level and node
        counts = got["v"].to_numpy().reshape(shape)
        fit.rounds.append(float(got["ll"].iloc[0]))
        new = [_item_step(a[i], d[i], counts[i, : len(levels[i])]) for i in range(len(items))]
        moved = max(max(abs(x - a[i]), float(np.abs(y - d[i]).max())) for i, (x, y) in enumerate(new))
        fit.slopes, fit.intercepts = np.array([x for x, _ in new]), [y for _, y in new]
        if moved < tolerance:
            break
    if fit.slopes.sum() < 0:
        fit.slopes = -fit.slopes
    return fit


def abilities(df: DataFrame, fit: ResponseFit, person: str, item: str, response: str) -> DataFrame:
    """(person, ability, se): mean and deviation of each person's ability given the responses; levels and items that the fit doesn't know count as missing."""
    patterns = response_patterns(df, person, item, response, fit.items, fit.levels)
    logs = _log_levels(fit.slopes, fit.intercepts)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for at in range(0, len(d), BATCH):
                w = _posterior(np.stack(d["pattern"].iloc[at : at + BATCH].to_list()), logs)[1]
                mean = w @ NODES
                yield pd.DataFrame({"person": d["person"].iloc[at : at + BATCH].to_numpy(), "ability": mean, "se": np.sqrt(np.maximum(w @ NODES**2 - mean**2, 0))})

    return patterns.mapInPandas(score, f"person {patterns.schema['person'].dataType.simpleString()}, ability double, se double").withColumnRenamed("person", person)
