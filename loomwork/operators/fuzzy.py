"""Fuzzy matching of texts by edit distances and character profiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import stored

#: Each method's default threshold (a distance, for jaro a similarity) .
THRESHOLDS = {"jaro": 0.85, "levenshtein": 2, "damerau": 2, "hamming": 2, "lcs": 2, "cosine": 0.2}
#: About so many characters are a segment of a text in edit distances, and about so many candidates of a segment go to one task.
SEGMENT = 3
HOT = 5_000


def normalise(text: Column, remove: Sequence[str] = (), prefix: str | None = None, suffix: str | None = None, lower: bool = True, punctuation: bool = True, spaces: bool = True) -> Column:
    """Fixed strings removed, then one prefix and suffix pattern, lower case, no ASCII punctuation, single spaces, trimmed."""
    for r in remove:
        text = F.replace(text, F.lit(r), F.lit(""))
    if prefix:
        text = F.regexp_replace(text, f"^(?:{prefix})", "")
    if suffix:
        text = F.regexp_replace(text, f"(?:{suffix})$", "")
    if lower:
        text = F.lower(text)
    if punctuation:
        text = F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " ")) if spaces else text


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _damerau(a: str, b: str) -> int:
    """Unrestricted: a transposition may be edited between."""
    big = len(a) + len(b)
    last: dict[str, int] = {}
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def _common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _by_pair(function, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([function(x, y) for x, y in zip(a, b, strict=True)])

    return run


def _characters(text: Column) -> Column:
    return F.split(text, "")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of the counts of characters."""
    count = lambda t, c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double")
    letters = F.array_distinct(F.concat(_characters(a), _characters(b)))
    letters = F.filter(letters, lambda c: c != "")
    total = lambda f: F.aggregate(letters, F.lit(0.0), lambda s, c: s + f(c))
    return 1 - total(lambda c: count(a, c) * count(b, c)) / F.sqrt(total(lambda c: count(a, c) * count(a, c)) * total(lambda c: count(b, c) * count(b, c)))


def _letters(texts: DataFrame) -> DataFrame:
    """(t, ch, n): how often each text has each character."""
    ch = F.explode(F.filter(_characters(F.col("t")), lambda c: c != ""))
    return texts.select("t", ch.alias("ch")).groupBy("t", "ch").agg(F.count(F.lit(1)).alias("n"))


def _rare_first(q: DataFrame, c: DataFrame, method: str, t: float) -> DataFrame:
    """(query, candidate) of every pair that can be within the threshold, by a prefix filter over characters, the rarest first.

    Jaro at least t needs m common characters (with repeats) with m / a + m / b >= 3 t - 1 and lengths in a
    ratio of at least 3 t - 2; so two texts share one of the rarest a - m + 1 characters of each, m the least that any allowed partner
    needs. For the cosine, characters behind the prefix have a norm below the similarity asked for, so they alone
    can't reach it. Pairs that pass are held against the bound itself before any distance is computed.
    """
    texts = q.select(F.col("query").alias("t")).union(c.select(F.col("candidate").alias("t"))).distinct()
    counts = stored(_letters(texts))
    seen = counts.groupBy("ch").agg(F.sum("n").alias("f"))
    if method == "jaro":
        units = counts.select("t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"), "ch").withColumn("size", F.length("t"))
        freq = units.groupBy("ch", "k").agg(F.count(F.lit(1)).alias("f"))
        ranked = units.join(freq, ["ch", "k"]).withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy("f", "ch", "k")))
        # the least share of its own characters that a text must have in common with an allowed partner
        least = F.ceil((3 * t - 1) * F.col("size") * max(3 * t - 2, 0.0) / (1 + max(3 * t - 2, 0.0)) - 1e-9)
        prefix = ranked.where(F.col("place") <= F.col("size") - F.greatest(least, F.lit(1)) + 1).select("t", F.concat_ws("#", "k", "ch").alias("token"))
    else:
        by_rarity = Window.partitionBy("t").orderBy("f", "ch")
        square = F.col("n").cast("double") * F.col("n")
        ranked = counts.join(seen, "ch").withColumn("before", F.coalesce(F.sum(square).over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("all", F.sum(square).over(Window.partitionBy("t")))
        # a character belongs to the prefix while what follows from it on can still reach the similarity alone
        prefix = ranked.where(F.col("all") - F.col("before") >= (1 - t) * (1 - t) * F.col("all") * (1 - 1e-9)).select("t", F.col("ch").alias("token"))
    prefix = stored(prefix)
    left, right = prefix.withColumnRenamed("t", "query").join(q, "query", "left_semi"), prefix.withColumnRenamed("t", "candidate").join(c, "candidate", "left_semi")
    la, lb = F.length("query"), F.length("candidate")
    pairs = left.join(right, "token")
    if method == "jaro":
        pairs = pairs.where(F.least(la, lb) / F.greatest(la, lb) >= 3 * t - 2 - 1e-12)
    pairs = pairs.select("query", "candidate").distinct()
    if method == "jaro":
        numbered = lambda x: F.transform(F.array_sort(_characters(F.col(x))), lambda ch, i: F.concat_ws("#", i - F.array_position(F.array_sort(_characters(F.col(x))), ch), ch))
        common = F.size(F.array_intersect(numbered("query"), numbered("candidate")))
        pairs = pairs.where(common / la + common / lb >= 3 * t - 1 - 1e-9)
    return pairs


def _segment_pairs(q: DataFrame, c: DataFrame, method: str, t: int) -> DataFrame:
    """(query, candidate) of every pair that can be within ``t`` edits: they share a segment of the candidate, at nearly the same place.

    A candidate is cut into even segments, of ``SEGMENT`` characters or more, up to four times as many as the edits can touch and
    always more than those: one each, two for an exchange of neighbours. So a partner keeps all but those few, moved by ``t`` places at most, and has one of
    *any* so many plus one: the rarest of the candidate's segments are its keys. Candidates too short for as many segments go by a common character
    (edits touch one each), those of no more than ``t`` by length alone. Segments of more than ``HOT`` candidates are dealt to several
    tasks, queries to each of them; segments that no candidate has as a key are dropped from the queries.
    """
    lost = 0 if t < 1 else 2 * t if method == "damerau" else t
    shift = 0 if method == "hamming" else t
    size = F.col("size")
    parts = F.when(size > lost, F.greatest(F.lit(lost + 1), F.least(F.floor(size / SEGMENT), F.lit(4 * (lost + 1))))).otherwise(F.lit(0)).cast("int")
    start = lambda i, n, k: F.floor(i * n / k).cast("int")

    def cut(i):
        lo, hi = start(i, size, F.col("parts")), start(i + 1, size, F.col("parts"))
        return F.struct(i.alias("i"), F.substr("candidate", lo + 1, hi - lo).alias("key"))

    d = c.withColumn("size", F.length("candidate")).withColumn("parts", parts)
    whole = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cut)
    letters = F.transform(F.array_distinct(F.filter(_characters(F.col("candidate")), lambda ch: ch != "")), lambda ch: F.struct(F.lit(-1).alias("i"), ch.alias("key")))
    none = F.array(F.struct(F.lit(-2).alias("i"), F.lit("").alias("key")))
    keys = stored(d.select("candidate", "size", F.explode(F.when(F.col("parts") > 0, whole).when(size > t, letters).otherwise(none)).alias("s")).select("candidate", "size", "s.i", "s.key"))
    seen = keys.groupBy("size", "i", "key").agg(F.count(F.lit(1)).alias("n"))
    ranked = keys.join(seen, ["size", "i", "key"]).withColumn("place", F.row_number().over(Window.partitionBy("candidate").orderBy("n", "i", "key")))
    keys = stored(ranked.where((F.col("i") < 0) | (F.col("place") <= lost + 1)).drop("place", "n"))
    tasks = stored(keys.groupBy("size", "i", "key").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("tasks")))
    # where each size's segments lie, and what the query has there or up to the shift beside
    own = F.length("query")
    asked = q.withColumn("size", F.explode(F.sequence(F.greatest(own - shift, F.lit(0)), own + shift))).withColumn("parts", parts)

    def pieces(i):
        lo, hi = start(i, size, F.col("parts")), start(i + 1, size, F.col("parts"))
        first, last = F.greatest(lo - shift, F.lit(0)), F.least(lo + shift, own - (hi - lo))
        at = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(i.alias("i"), F.substr("query", p + 1, hi - lo).alias("key")))

    there = F.flatten(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pieces))
    single = F.transform(F.array_distinct(F.filter(_characters(F.col("query")), lambda ch: ch != "")), lambda ch: F.struct(F.lit(-1).alias("i"), ch.alias("key")))
    asked = asked.select("query", "size", F.explode(F.array_distinct(F.when(F.col("parts") > 0, there).when(size > t, single).otherwise(none))).alias("s")).select("query", "size", "s.i", "s.key")
    asked = asked.join(tasks, ["size", "i", "key"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    dealt = keys.join(tasks, ["size", "i", "key"]).withColumn("task", F.pmod(F.xxhash64("candidate"), F.col("tasks")).cast("int")).drop("tasks")
    return asked.join(dealt, ["size", "i", "key", "task"]).select("query", "candidate").distinct()


def fuzzy_match(
    queries: DataFrame, candidates: DataFrame, query_col: str, candidate_col: str, methods: Sequence[str] = tuple(THRESHOLDS), thresholds: Mapping[str, float] | None = None, top: int | None = None
) -> DataFrame:
    """(query, candidate, method, distance, similarity, match_rank) of pairs within the method's threshold.

    Each side's distinct texts are compared once. Edit distances pair texts whose lengths differ by no more
    than the threshold and that share a rare segment, see ``_segment_pairs``; jaro and cosine pairs come from a prefix filter over rare
    characters, see ``_rare_first``. Texts without characters match by edit distances only. Similarity is a
    percentage; equal ones share the least rank; ``top`` keeps ranks up to it.
    """
    limits = {**THRESHOLDS, **(thresholds or {})}
    if bad := [m for m in methods if m not in THRESHOLDS]:
        raise ValueError(f"unknown methods: {', '.join(bad)}")
    q = queries.select(F.col(query_col).alias("query")).where("query is not null").distinct()
    c = candidates.select(F.col(candidate_col).alias("candidate")).where("candidate is not null").distinct()
    la, lb = F.length("query"), F.length("candidate")
    longest = F.greatest(la, lb, F.lit(1))
    out = None
    for m in methods:
        t = limits[m]
        if m in ("jaro", "cosine"):
            pairs = _rare_first(q, c, m, t)
            if m == "jaro":
                pairs = pairs.withColumn("distance", 1 - _by_pair(_jaro, "double")("query", "candidate"))
                pairs = pairs.where(F.col("distance") <= 1 - t + 1e-12).withColumn("s", 1 - F.col("distance"))
            else:
                pairs = pairs.withColumn("distance", cosine_distance(F.col("query"), F.col("candidate"))).where(F.col("distance") <= t + 1e-12).withColumn("s", 1 - F.col("distance"))
        else:
            pairs = _segment_pairs(q, c, m, int(t))
            if m == "levenshtein":
                d = F.levenshtein("query", "candidate", int(t))
                pairs = pairs.where(d >= 0)
            elif m == "hamming":
                d = F.aggregate(F.zip_with(_characters(F.col("query")), _characters(F.col("candidate")), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
            else:
                # an edit adds, drops or exchanges a character: texts with more than t characters of their own differ by more
                own = F.greatest(F.size(F.array_except(_characters(F.col("query")), _characters(F.col("candidate")))), F.size(F.array_except(_characters(F.col("candidate")), _characters(F.col("query")))))
                pairs = pairs.where(own <= t)
                d = _by_pair(_damerau, "int")("query", "candidate") if m == "damerau" else la + lb - 2 * _by_pair(_common_subsequence, "int")("query", "candidate")
            pairs = pairs.withColumn("distance", d.cast("double")).where(F.col("distance") <= t)
            pairs = pairs.withColumn("s", 1 - F.col("distance") / (F.greatest(la + lb, F.lit(1)) if m == "lcs" else longest))
        pairs = pairs.select("query", "candidate", F.lit(m).alias("method"), "distance", (100 * F.col("s")).alias("similarity"))
        out = pairs if out is None else out.union(pairs)
    out = out.withColumn("match_rank", F.rank().over(Window.partitionBy("query", "method").orderBy(F.desc("similarity"))))
    return out.where(F.col("match_rank") <= top) if top else out


def match_statistics(matches: DataFrame) -> DataFrame:
    """Per pair: how many methods matched, mean and median similarity."""
    return matches.groupBy("query", "candidate").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean_similarity"), F.median("similarity").alias("median_similarity"))
