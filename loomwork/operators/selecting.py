"""Choosing predictors: forests against shuffled copies, and sparse linear fits from products by fold."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, stored
from loomwork.functions.ordered import numbered
from loomwork.operators.models import random_forest

#: Products of more predictors than this don't fit in one row.
MOST_PREDICTORS = 200
#: Rows in a range of the shuffled order, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 100_000, 1 << 16
#: Rounds whose copies are made together.
TOGETHER = 3


def _complete(df: DataFrame, id_col: str, target: str, features: Sequence[str]) -> DataFrame:
    """Rows with all values known and finite: the id as __id, __y, x0, x1..."""
    require_columns(df, [id_col, target, *features])
    d = df.select(F.col(id_col).alias("__id"), F.col(target).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    for c in d.columns[1:]:
        d = d.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != math.inf))
    return d


def _tail(hits: int, rounds: int) -> float:
    """The chance of at least so many hits of a fair coin."""
    return sum(math.comb(rounds, i) for i in range(hits, rounds + 1)) / 2**rounds


def shuffled(d: DataFrame, columns: Sequence[str], seed: int, total: int) -> DataFrame:
    """(__rn, s_...): the ``columns`` of a table of ``total`` rows numbered by ``__rn``, each row's under another number: a seeded shuffle of the whole table.

    The rows are put in the order of a hash of their number and numbered again. A hash is even, so its leading bits deal the order to
    tasks, and counts by these bits (at most ``MOST_RANGES`` rows) say what lies before a range: rows move twice, and nothing is written.
    """
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, min(MOST_RANGES, max(8 * n, total // RANGE_ROWS)).bit_length() - 1)
    at = F.xxhash64("__rn", F.lit(seed))  # not sent along: it can be had from the number
    cell = F.shiftright(at, 64 - bits).alias("__cell")
    counts = d.groupBy(cell).agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select(F.col("__cell").alias("__c"), earlier.alias("__before"))  # a row per range
    mixed = d.select("__rn", *columns).repartition(n, cell).withColumn("__cell", cell)
    mixed = mixed.withColumn("__in", F.row_number().over(Window.partitionBy("__cell").orderBy(at, "__rn")))
    mixed = mixed.join(F.broadcast(before), F.col("__cell") == F.col("__c"))
    return mixed.select((F.col("__before") + F.col("__in")).alias("__rn"), *[F.col(c).alias(f"s_{c}") for c in columns]).repartition(n, "__rn")


def shadow_table(d: DataFrame, columns: Sequence[str], seed: int) -> DataFrame:
    """A table numbered by ``__rn`` with ``columns`` of another row beside each row's own, as ``s_``; see ``shuffled``."""
    return d.join(shuffled(d, columns, seed, d.count()), "__rn")


def shadow_selection(df: DataFrame, id_col: str, target: str, features: Sequence[str], kind: str = "regress", rounds: int = 20, trees: int = 50, level: float = 0.01, seed: int = 0) -> DataFrame:
    """(feature, hits, rounds, decision): predictors that a forest prefers to shuffled copies of them.

    Each round shuffles the predictors over the whole table (one order for all of them, so that copies keep what they have in common and lose
    the target), fits a forest to both, and counts a hit where a predictor's importance exceeds that of every copy. A binomial
    test, with ``level`` shared by all predictors, makes a predictor ``confirmed`` or ``rejected``; rejected ones leave the
    next rounds; what is open at the end is ``tentative``. ``kind`` classify needs a target of 0, 1...

    Rows with unknown values take no part. Rows are numbered by id and, where ids repeat, by a hash of their values, and lie in
    that order when a forest is fitted: the same table gives the same rows each time. A table without rows leaves all tentative, with no rounds.
    """
    names = [f"x{i}" for i in range(len(features))]
    d = stored(numbered(_complete(df, id_col, target, features).withColumn("__v", F.xxhash64("__y", *names)), ["__id", "__v"]).select("__rn", "__y", *names))
    hits, done, decision = dict.fromkeys(names, 0), dict.fromkeys(names, 0), dict.fromkeys(names, "tentative")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = d.count()
    for r in range(rounds if total else 0):
        live = [c for c in names if decision[c] != "rejected"]
        if all(decision[c] == "confirmed" for c in live):
            break
        if r % TOGETHER == 0:  # one row holds the copies of some rounds, so that its own values move and are written once
            rows = d.select("__rn", "__y", *live).repartition(n, "__rn")
            for i in range(r, min(r + TOGETHER, rounds)):
                copies = shuffled(d, live, seed * 1_000_003 + i, total).withColumnsRenamed({f"s_{c}": f"s{i}_{c}" for c in live})
                rows = rows.join(copies.hint("merge"), "__rn")
            rows = stored(rows.repartition(n, "__rn").sortWithinPartitions("__rn"))
        both = [*live, *[f"s{r}_{c}" for c in live]]
        weight = random_forest(rows, "__y", both, kind, trees, seed + r).stages[-1].featureImportances.toArray()
        best = max(weight[len(live) :])
        for c, w in zip(live, weight, strict=False):
            hits[c] += int(w > best)
            done[c] += 1
            if decision[c] == "tentative" and _tail(hits[c], done[c]) < level / len(names):
                decision[c] = "confirmed"
            elif decision[c] == "tentative" and _tail(done[c] - hits[c], done[c]) < level / len(names):
                decision[c] = "rejected"
    out = [(f, hits[c], done[c], decision[c]) for f, c in zip(features, names, strict=True)]
    return df.sparkSession.createDataFrame(out, "feature string, hits int, rounds int, decision string")


def _descend(xx: np.ndarray, xy: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent on mean products of centred columns."""
    b = start.copy()
    for _ in range(10_000):
        before = b.copy()
        for j in range(len(b)):
            if xx[j, j] > 0:
                pull = xy[j] - xx[j] @ b + xx[j, j] * b[j]
                b[j] = math.copysign(max(abs(pull) - penalty, 0.0), pull) / xx[j, j]
        if np.abs((b - before) * np.sqrt(np.maximum(np.diag(xx), 0))).max(initial=0.0) < 1e-12 * math.sqrt(1e-300 + np.abs(xy).max(initial=0.0)):
            break
    return b


def sparse_linear(df: DataFrame, id_col: str, target: str, features: Sequence[str], folds: int = 10, steps: int = 100, seed: int = 0) -> DataFrame:
    """(feature, coefficient, selected, penalty): the linear fit with absolute penalties whose penalty has the least held-out error.

    Columns are centred, not scaled. Products by fold (of a hash of the id) are one aggregate; penalties from the least that leaves
    no predictor down to a ten-thousandth of it are fitted to the folds' sums, and held-out errors come from the same products. At most
    ``MOST_PREDICTORS`` predictors (ValueError beyond); rows with unknown values take no part, without rows nothing is selected.
    """
    k = len(features)
    if k > MOST_PREDICTORS:
        raise ValueError(f"more than {MOST_PREDICTORS} predictors")
    d = _complete(df, id_col, target, features)
    shift = d.agg(F.avg("__y"), *[F.avg(f"x{i}") for i in range(k)]).first()  # products about the means keep their digits
    schema = "feature string, coefficient double, selected boolean, penalty double"
    if shift[0] is None:
        return df.sparkSession.createDataFrame([(f, 0.0, False, None) for f in features], schema)
    cols = [F.lit(1.0), *[F.col(f"x{i}") - F.lit(shift[i + 1]) for i in range(k)], F.col("__y") - F.lit(shift[0])]
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    sums = d.groupBy(F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(folds)).alias("fold")).agg(F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("s")).orderBy("fold").collect()  # a row per fold
    product = np.zeros((len(sums), k + 2, k + 2))
    for f, r in enumerate(sums):
        for (i, j), v in zip(pairs, r["s"], strict=True):
            product[f, i, j] = product[f, j, i] = v

    def centred(g):
        m = g[0] / g[0, 0]
        return g / g[0, 0] - np.outer(m, m), m

    def path(g, penalties):
        c, m = centred(g)
        b, out = np.zeros(k), []
        for p in penalties:
            b = _descend(c[1:-1, 1:-1], c[1:-1, -1], p, b)
            out.append(np.concatenate([[-(m[-1] - m[1:-1] @ b)], -b, [1.0]]))  # the error as a combination of products' columns
        return out

    whole = product.sum(axis=0)
    top = np.abs(centred(whole)[0][1:-1, -1]).max(initial=0.0)
    penalties = top * 10.0 ** np.linspace(0, -4, steps)
    error = np.zeros(steps)
    if len(sums) > 1:
        for f in range(len(sums)):
            error += [e @ product[f] @ e for e in path(whole - product[f], penalties)]
    best = int(error.argmin())
    b = -path(whole, penalties[: best + 1])[-1][1:-1]
    return df.sparkSession.createDataFrame([(f, float(v), bool(v != 0), float(penalties[best])) for f, v in zip(features, b, strict=True)], schema)
