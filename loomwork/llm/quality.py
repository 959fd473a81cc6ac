"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.hashed_text import SLOTS, Scorer, fit_in_task, fit_sparse, labelled_sample, scored, sigmoid, text_slots

#: Rated documents that the model is fitted on at most.
SAMPLE = 8_000


class OrdinalModel:
    """P(grade <= k) = sigmoid(threshold_k - score): one score of shared hashed-text weights, ordered thresholds.

    ``grades`` are the grades in order, ``thresholds`` one fewer.
    """

    def __init__(self, grades: np.ndarray, thresholds: np.ndarray, weights: np.ndarray):
        self.grades, self.thresholds, self.weights = grades, thresholds, weights

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        upto = np.hstack([sigmoid(self.thresholds[None] - score[:, None]), np.ones((len(score), 1))])
        return np.diff(upto, axis=1, prepend=0.0)

    def scorer(self):
        run = Scorer([self.weights[:SLOTS]])

        def score(texts: list) -> np.ndarray:
            s, n = run(texts)
            return s[:, 0] / np.sqrt(n + 1)

        return score


def fit_ordinal(slots: np.ndarray, starts: np.ndarray, words: np.ndarray, grade: np.ndarray, k: int, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, weights) by maximum likelihood over texts whose ``grade`` runs from 0 to k - 1.

    Weights follow mini-batch FTRL; thresholds take gradient steps and are kept in order.
    """
    share = np.clip(np.cumsum(np.bincount(grade, minlength=k))[:-1] / len(grade), 1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))

    def slope(rows: np.ndarray, score: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[-np.inf], cut, [np.inf]])
        y = grade[rows]
        high, low = sigmoid(ends[y + 1] - score), sigmoid(ends[y] - score)
        gap = np.maximum(high - low, 1e-9)
        move = np.zeros(k + 1)
        np.add.at(move, y + 1, -high * (1 - high) / gap)
        np.add.at(move, y, low * (1 - low) / gap)
        cut[:] = np.maximum.accumulate(cut - 0.5 * move[1:-1] / len(rows) + 1e-6 * np.arange(k - 1))
        return 1 - high - low

    scale = 1 / np.sqrt(words + 1)
    weights = fit_sparse(slots, starts, scale, np.zeros((len(grade), 0)), slope, np.arange(len(grade)), epochs, alpha=2.0, l1=1.0)
    return cut - weights[-1], weights  # the bias moves all thresholds alike


def fit_quality(docs: DataFrame, ratings: DataFrame, grade_col: str = "grade", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """Fit on at most ``sample`` rated documents (a bounded sample by hash of the id); None if none is rated."""
    rated = labelled_sample(docs, ratings.select(id_col, F.col(grade_col).cast("double").alias("grade")), ["grade"], sample, id_col, text_col)

    def fit(x: pd.DataFrame) -> dict[str, np.ndarray]:
        grades, y = np.unique(x["grade"].to_numpy(), return_inverse=True)
        slots, starts = text_slots(x["text"].tolist())
        words = np.array([len(set(t.split())) if isinstance(t, str) else 0 for t in x["text"]], dtype=float)
        if len(grades) < 2:
            return {"lowest": grades, "steps": np.zeros(0), "thresholds": np.zeros(0), "weights": np.zeros(SLOTS + 1)}
        thresholds, weights = fit_ordinal(slots, starts, words, y, len(grades))
        return {"lowest": grades[:1], "steps": np.diff(grades), "thresholds": thresholds, "weights": weights}

    got = fit_in_task(rated, fit)
    if not got:
        return None
    return OrdinalModel(got["lowest"][0] + np.concatenate([[0.0], np.cumsum(got["steps"])]), got["thresholds"], got["weights"])


def grade_documents(
    docs: DataFrame, ratings: DataFrame, keep_grade: float, keep_probability: float = 0.5, grade_col: str = "grade", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of ``keep_grade`` or more) and ``kept``.

    A document is kept if its tail probability is ``keep_probability`` or more. Ratings may have any
    number of grades, any numbers. Without any rated document both figures are null and all rows are
    kept; with one grade that grade is certain. Null texts count as empty. Ratings with a null id or
    grade are ignored. Repeated rows score alike; existing columns of the new names are replaced.
    """
    model = fit_quality(docs, ratings, grade_col, sample, id_col, text_col)
    out = docs.drop("expected_grade", "tail_probability", "kept")
    if model is None:
        none = F.lit(None).cast("double")
        return out.withColumn("expected_grade", none).withColumn("tail_probability", none).withColumn("kept", F.lit(True))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights

    def make():
        m = shared.value
        score, tail = m.scorer(), m.grades >= keep_grade

        def run(texts: list) -> np.ndarray:
            p = m.probabilities(score(texts))
            return np.stack([p @ m.grades, np.minimum(1.0, p[:, tail].sum(1))], 1)

        return run

    out = scored(out, text_col, ["expected_grade", "tail_probability"], make)
    return out.withColumn("kept", F.col("tail_probability") >= keep_probability)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 poor, 1 good but toxic, 2 good and clean; null labels give no grade.

    If only the quality is known the grade is 2 or 0.
    """
    good = F.col("quality") > 0
    return labels.select("doc_id", F.when(good & (F.col("toxic") > 0), 1).when(good, 2).when(F.col("quality").isNotNull(), 0).alias("grade"))
