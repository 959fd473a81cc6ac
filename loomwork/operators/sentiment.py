"""Sentiment by word lists, negation and intensifiers, and keyword shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A few words with values, for examples and tests; real word lists come as a table (token, value).
LEXICON = {"good": 1.0, "great": 1.0, "happy": 1.0, "love": 1.0, "best": 1.0, "bad": -1.0, "poor": -1.0, "sad": -1.0, "hate": -1.0, "worst": -1.0, "stupid": -1.0, "trash": -1.0}
# Words that turn the next one's sign or double it, and the cut-offs between labels by method.
NEGATIONS = ("not", "no", "never", "neither", "nor", "none", "nothing", "nowhere", "hardly", "barely", "rarely", "seldom", "scarcely")
INTENSIFIERS = ("very", "so", "really", "quite", "extremely")
CUT_OFFS = {"syuzhet": 0.5, "afinn": 5.0, "bing": 1.0}
#: A word: lower-case letters, digits and apostrophes.
WORD = r"[a-z0-9']+"


def lexicon_frame(df: DataFrame, lexicon: Mapping[str, float] | DataFrame) -> DataFrame:
    """(token, value): a mapping as a table, or a table as it is; repeated tokens take their mean value."""
    if isinstance(lexicon, DataFrame):
        return lexicon.groupBy("token").agg(F.avg("value").alias("value"))
    return df.sparkSession.createDataFrame(list(lexicon.items()), "token string, value double")


def _with_lexicon(words: DataFrame, lexicon: DataFrame, most: int = 100_000) -> DataFrame:
    small = lexicon.limit(most + 1).count() <= most
    return words.join(F.broadcast(lexicon) if small else lexicon, "token")


def sentiment_scores(df: DataFrame, key: str, text_col: str, lexicon: Mapping[str, float] | DataFrame = LEXICON) -> DataFrame:
    """(key, score): the sum of the values of a text's words; a text without words has null, one without listed words 0.

    Only listed words are shuffled, summed where they are found first. Rows that repeat a key share its sum.
    """
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(f"({WORD})"), 1)).alias("token"))
    sums = _with_lexicon(words, lexicon_frame(df, lexicon)).groupBy(key).agg(F.sum("value").alias("score"))
    some = F.lower(text_col).rlike(WORD)
    return df.select(key, some.alias("__some")).join(sums, key, "left").select(key, F.coalesce("score", F.when(F.col("__some"), F.lit(0.0))).alias("score"))


def label(score: Column, cut: float) -> Column:
    """positive above the cut, negative below its opposite, else (or unknown) neutral."""
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def negated_sentiment(df: DataFrame, key: str, text_col: str, lexicon: Mapping[str, float] | DataFrame = LEXICON) -> DataFrame:
    """(key, score): negations turn the sign of the next word's value, intensifiers double it; several in a row add up ("not very good").

    A word is taken together with the shifters right before it by one pattern, so no order of words is kept.
    """
    shifter = f"(?:{'|'.join((*NEGATIONS, *INTENSIFIERS))})"
    phrase = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(f"((?:{shifter}(?![a-z0-9'])[^a-z0-9']+)*{WORD})"), 1))
    words = df.select(key, phrase.alias("phrase")).withColumn("token", F.regexp_extract("phrase", f"({WORD})$", 1))
    hits = _with_lexicon(words, lexicon_frame(df, lexicon))
    parts = F.split(F.col("phrase"), "[^a-z0-9']+")
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)
    turned = F.size(F.filter(before, lambda w: w.isin(*NEGATIONS)))
    value = F.col("value") * F.when(turned % 2 == 1, -1.0).otherwise(1.0) * F.pow(F.lit(2.0), F.size(F.filter(before, lambda w: w.isin(*INTENSIFIERS))))
    return df.select(key).join(hits.groupBy(key).agg(F.sum(value).alias("score")), key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def sentiment_summary(df: DataFrame, score_columns: Mapping[str, str], item: str) -> DataFrame:
    """Mean score and label per method, from wide columns (name -> method): item means first, then their mean."""
    long = df.unpivot([item], list(score_columns), "column", "score")
    names = F.create_map(*[F.lit(x) for kv in score_columns.items() for x in kv])
    m = long.withColumn("method", F.try_element_at(names, F.col("column"))).groupBy("method", "column", item).agg(F.avg("score").alias("score"))
    m = m.groupBy("method", "column").agg(F.avg("score").alias("score"))
    cut = F.create_map(*[F.lit(x) for kv in CUT_OFFS.items() for x in kv])
    return m.withColumn("label", label(F.col("score"), F.coalesce(F.try_element_at(cut, F.col("method")), F.lit(float("inf")))))


def category_shares(df: DataFrame, text_col: str, by: Sequence[str], categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per group and category: rows that hold one of its keywords (literally), and their percentage of the group's hits."""
    flags = {n: F.greatest(*[F.contains(F.col(text_col), F.lit(k)).cast("int") for k in ks], F.lit(0)) for n, ks in categories.items()}
    sums = df.groupBy(*by).agg(*[F.sum(f).alias(n) for n, f in flags.items()])
    long = sums.unpivot(list(by), list(categories), "category", "n")
    total = F.sum("n").over(Window.partitionBy(*by))
    return long.withColumn("pct", F.when(total > 0, 100 * F.col("n") / total).otherwise(0.0))
