"""Toxicity: a chain of sparse linear classifiers, each fed with the probabilities of those before it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.hashed_text import SLOTS, Scorer, fit_in_task, fit_sparse, labelled_sample, scored, sigmoid, text_slots

#: Labelled documents that the chain is fitted on at most.
SAMPLE = 12_000
FOLDS = 3


def fit_chain(slots: np.ndarray, starts: np.ndarray, labels: np.ndarray, folds: np.ndarray, epochs: int = 5) -> list[np.ndarray]:
    """Weights of each link: slots, a weight per earlier category, bias.

    A later link is trained with out-of-fold probabilities of the earlier categories: those of a
    document come from models that haven't seen its fold, as they will be for new documents.
    """
    n, k = labels.shape
    earlier, out = np.zeros((n, 0)), []

    def fit(y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return fit_sparse(slots, starts, np.ones(n), earlier, lambda r, s: sigmoid(s) - y[r], rows, epochs, alpha=0.5, l1=3.0, evidence=True)

    def predict(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        size = starts[rows + 1] - starts[rows]
        idx = np.concatenate([slots[starts[i] : starts[i + 1]] for i in rows])
        s = np.bincount(np.repeat(np.arange(len(rows)), size), w[idx], len(rows))
        return sigmoid(s + earlier[rows] @ w[SLOTS:-1] + w[-1])

    for c in range(k):
        y = labels[:, c]
        out.append(fit(y, np.arange(n)))
        if c + 1 < k:
            p = np.zeros(n)
            for f in np.unique(folds):
                inside, outside = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
                p[inside] = predict(fit(y, outside), inside) if len(outside) else y[inside].mean()
            earlier = np.hstack([earlier, p[:, None]])
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[np.ndarray] | None:
    """The chain in the order of ``categories`` (0/1 columns of ``labels``), from at most ``sample`` labelled documents; None without any."""
    names = list(categories)
    known = labels.select(id_col, *[(F.col(c) > 0).cast("double").alias(c) for c in names])

    def fit(x: pd.DataFrame) -> dict[str, np.ndarray]:
        slots, starts = text_slots(x["text"].tolist())
        folds = np.random.default_rng(0).permutation(len(x)) % FOLDS
        return {str(i): w for i, w in enumerate(fit_chain(slots, starts, x[names].to_numpy(), folds))}

    got = fit_in_task(labelled_sample(docs, known, names, sample, id_col, text_col), fit)
    return [got[str(i)] for i in range(len(names))] if got else None


def classify_toxicity(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], threshold: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category, and ``toxic``: whether the last one's is ``threshold`` or more.

    Categories are predicted in the order given, each from the text and the probabilities before it.
    Null texts count as empty. Labels with a null id or a null category are ignored; without any
    labelled document the probabilities are null and nothing is toxic. Repeated rows score alike;
    existing columns of the new names are replaced.
    """
    columns = [f"p_{c}" for c in categories]
    chain = fit_toxicity(docs, labels, categories, sample, id_col, text_col)
    out = docs.drop(*columns, "toxic")
    if chain is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in columns}).withColumn("toxic", F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # SLOTS weights a category

    def make():
        links = shared.value
        run = Scorer([w[:SLOTS] for w in links])

        def score(texts: list) -> np.ndarray:
            s, _ = run(texts)
            p = np.zeros_like(s)
            for i, w in enumerate(links):
                p[:, i] = sigmoid(s[:, i] + p[:, :i] @ w[SLOTS:-1] + w[-1])
            return p

        return score

    return scored(out, text_col, columns, make).withColumn("toxic", F.col(columns[-1]) >= threshold)


def categories_of(labels: DataFrame) -> DataFrame:
    """The chain's categories in the ``labels`` table: poor quality first (noise of the kind that hides or mimics abuse), then toxicity."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("poor"), F.col("toxic"))
