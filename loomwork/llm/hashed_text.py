"""Hashed features of texts and sparse linear models over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

#: Hash slots of the features; a model has one weight for each.
SLOTS = 1 << 18
#: Mini-batches that a fit takes at least, however few rows it has.
LEAST_STEPS = 400
#: Words whose features or scores a task remembers.
MEMO_WORDS = 300_000


def word_slots(word: str) -> tuple[int, ...]:
    """Slots of one word: itself and its first four and five letters, lower-cased, and its shape."""
    core = word.strip("\"'.,;:!?()[]{}")
    low = core.lower()
    if core.isalpha() and (core == low or core[1:] == low[1:]):
        shape = word.replace(core, "a" if core == low else "Aa", 1)[:12]
    else:
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:64]]
        shape = "".join([c for c, before in zip(kinds, ["", *kinds], strict=False) if c != before][:12])
    whole, four, five, form = (x.encode("utf-8", "surrogatepass") for x in (low, low[:4], low[:5], shape))
    return xxh32_intdigest(whole, 1) % SLOTS, xxh32_intdigest(four, 2) % SLOTS, xxh32_intdigest(five, 3) % SLOTS, xxh32_intdigest(form, 4) % SLOTS


def document_slots(words: list[str]) -> tuple[int, ...]:
    """Slots of the whole text: how many words equal the one before, how few are distinct, how long it is (coarsely)."""
    n = len(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    keys = (f"repeat {10 * same // max(n, 1)}", f"distinct {10 * len(set(words)) // max(n, 1)}", f"size {n.bit_length()}")
    return tuple(xxh32_intdigest(k.encode(), 5) % SLOTS for k in keys)


def text_slots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, starts): the slots of each text's distinct words and of the text, with repeats; null is empty."""
    memo: dict[str, tuple[int, ...]] = {}
    slots, starts = [], [0]
    for t in texts:
        words = t.split() if isinstance(t, str) else []
        own = []
        for w in set(words):
            s = memo.get(w)
            if s is None:
                s = memo[w] = word_slots(w)
            own.append(s)
        x = np.fromiter(chain(chain.from_iterable(own), document_slots(words)), np.int32)
        slots.append(x)
        starts.append(starts[-1] + len(x))
        if len(memo) > MEMO_WORDS:
            memo.clear()
    return (np.concatenate(slots) if slots else np.zeros(0, np.int32)), np.array(starts)


class Scorer:
    """Sums of weights over a text's slots; the sum of a word's weights is remembered, so a text costs a lookup per distinct word.

    ``models`` are weight vectors; the result has a column for each.
    """

    def __init__(self, models: list[np.ndarray]):
        self.weights = [m.tolist() for m in models]
        self.memo: dict[str, tuple[float, ...]] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, numbers of distinct words)."""
        out, n = np.zeros((len(texts), len(self.weights))), np.zeros(len(texts))
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for i, t in enumerate(texts):
            words = t.split() if isinstance(t, str) else []
            distinct = set(words)
            for w in distinct.difference(memo):
                at = word_slots(w)
                memo[w] = tuple([sum([x[s] for s in at]) for x in self.weights])
            known = [memo[w] for w in distinct]
            known.append(tuple([sum([x[s] for s in document_slots(words)]) for x in self.weights]))
            out[i] = [sum(column) for column in zip(*known, strict=True)]
            n[i] = len(distinct)
        return out, n


class Ftrl:
    """Follow-the-regularised-leader: adaptive steps per weight, and weights that noise moves stay zero.

    With ``evidence`` no slot's weight falls below zero: features can only speak for the label, so the
    many neutral words of a long text don't outweigh a few telling ones.
    """

    def __init__(self, size: int, alpha: float = 0.1, l1: float = 1.0, l2: float = 1.0, evidence: bool = False):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.l1, self.l2 = alpha, l1, l2
        self.floor = np.where(np.arange(size) < SLOTS, 0.0, -np.inf) if evidence else np.full(size, -np.inf)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.maximum(self.floor[at], np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((1.0 + np.sqrt(n)) / self.alpha + self.l2)))

    def step(self, at: np.ndarray, g: np.ndarray) -> None:
        w = self.weights(at)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit_sparse(slots: np.ndarray, starts: np.ndarray, scale: np.ndarray, extra: np.ndarray, slope: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: np.ndarray, epochs: int = 6, batch: int = 64, seed: int = 0, **options) -> np.ndarray:
    """Weights of a linear score: slots first, then a weight per column of ``extra``, then the bias.

    A text's slot counts are multiplied by its ``scale``. ``slope(rows, scores)`` is the loss's derivative
    by the score. Mini-batches in an order drawn from ``seed``; few rows are passed over more often, so that
    at least LEAST_STEPS are taken.
    """
    k = extra.shape[1] + 1
    model = Ftrl(SLOTS + k, **options)
    rng = np.random.default_rng(seed)
    dense = np.hstack([extra, np.ones((len(extra), 1))])
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(rows))))):
        order = rng.permutation(rows)
        for at in range(0, len(order), batch):
            r = order[at : at + batch]
            size = starts[r + 1] - starts[r]
            idx = np.concatenate([slots[starts[i] : starts[i + 1]] for i in r])
            owner = np.repeat(np.arange(len(r)), size)
            used, local = np.unique(idx, return_inverse=True)
            w = model.weights(used)
            tail = np.arange(SLOTS, SLOTS + k)
            score = np.bincount(owner, w[local], len(r)) * scale[r] + dense[r] @ model.weights(tail)
            g = slope(r, score)
            model.step(used, np.bincount(local, (g * scale[r])[owner], len(used)))
            model.step(tail, g @ dense[r])
    return model.weights()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, id_col: str, text_col: str) -> DataFrame:
    """At most ``most`` labelled documents, those of the least hashed ids: (id, text, columns).

    Rows with a null id or label, and labels without a document, are left out; of labels that repeat an id
    one is taken, of documents that repeat an id the least text.
    """
    usable = labels.where(F.col(id_col).isNotNull())
    for c in columns:
        usable = usable.where(F.col(c).isNotNull())
    usable = usable.groupBy(F.col(id_col).alias("__id")).agg(*[F.min(c).alias(c) for c in columns])
    ids = docs.select(F.col(id_col).alias("__id")).where("__id is not null")
    chosen = usable.join(ids, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(most)  # the bound keeps the broadcast small
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    return found.groupBy("__id", *columns).agg(F.min("__text").alias("__text")).select(F.col("__id").alias("id"), F.col("__text").alias("text"), *columns)


def fit_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Run ``fit`` over a bounded sample in one task; its arrays come back to the driver without their zeros."""

    def task(x: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, a in fit(x.sort_values("id", ignore_index=True)).items():
            at = np.flatnonzero(a)
            rows.append((name, len(a), at.tolist(), a[at].tolist()))
        return pd.DataFrame(rows, columns=["name", "size", "at", "value"])

    out = {}
    for r in sample.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(task, "name string, size long, at array<long>, value array<double>").collect():
        a = np.zeros(r["size"])
        a[r["at"]] = r["value"]
        out[r["name"]] = a
    return out


def scored(docs: DataFrame, text_col: str, columns: list[str], score: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """``docs`` with double columns that ``score()``, made once per task, gives for each text."""

    @F.pandas_udf(", ".join(f"{c} double" for c in columns))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = score()
        for texts in batches:
            yield pd.DataFrame(f(texts.tolist()), columns=columns)

    out = docs.drop(*columns).withColumn("__scores", run(F.col(text_col)))
    return out.select("*", *[F.col(f"__scores.{c}").alias(c) for c in columns]).drop("__scores")
