"""Quality rules as a learned decision list: text statistics, sequential covering over labelled counts, conditional expressions.

DataFrame functions throughout. The driver sees counts by feature, threshold bin and label, and holds the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, materialise

#: What a document must have before the learned rules are asked.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Statistics that rules may ask for, as ratios of the counts.
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "duplicate_line_share", "repeat_word_share", "upper_share", "digit_share", "mark_share", "distinct_word_share", "words_per_line")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with counts over whole texts: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``, ``n_distinct_words``, ``n_upper``, ``n_digits``, ``n_marks`` (all long).

    Words are runs of anything but ASCII white space. A line is a duplicate if it has a word and an earlier line equals it. A word is
    repeated if it lies in a window of three words that occurs at least twice (windows are told apart by XXH64). Null texts have none.
    The windows of a text are put in order only if some are equal, in the row's own task: n log n for the longest.
    """
    text, n = F.coalesce(F.col(text_col), F.lit("")), F.size("__w")
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))
    # places of windows that have an equal: in the order of (hash, place) an equal one stands beside
    ordered = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = F.zip_with(F.slice("__o", 1, F.size("__o") - 1), F.slice("__o", 2, F.size("__o") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    gaps = F.zip_with(F.slice("__p", 1, F.size("__p") - 1), F.slice("__p", 2, F.size("__p") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3), lambda s, x: s + x)
    out = docs.withColumn("__t", text).withColumn("__w", F.regexp_extract_all("__t", F.lit(f"({WORD})"), F.lit(0)))
    out = out.withColumn("__h", F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>"))).withColumn("__d", lines)
    out = out.withColumn("__o", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), ordered))
    out = out.withColumn("__p", F.when(F.col("__o").isNotNull(), F.sort_array(F.array_distinct(F.flatten(beside)))))
    counts = {
        "n_words": n, "word_chars": F.length(F.array_join("__w", "")), "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("__d") - F.size(F.array_distinct("__d")), "n_repeat_words": F.when(F.col("__p").isNotNull(), covered).otherwise(0),
        "n_lines": F.size("__d"), "n_distinct_words": F.size(F.array_distinct("__w")),
        "n_upper": F.regexp_count("__t", F.lit(r"\p{Lu}")), "n_digits": F.regexp_count("__t", F.lit("[0-9]")), "n_marks": F.regexp_count("__t", F.lit(r"[!?|{}\[\]@=_~^]")),
    }
    return out.select(*docs.columns, *[c.cast("long").alias(name) for name, c in counts.items()])


def features() -> dict[str, Column]:
    """Ratios of the counts, each a double; 0 where there is nothing to divide by."""

    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    pairs = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_digits", "word_chars"), ("n_marks", "word_chars"), ("n_distinct_words", "n_words"), ("n_words", "n_lines"))
    return dict(zip(FEATURES, [F.col("n_words").cast("double"), *[over(a, b) for a, b in pairs]], strict=True))


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold``, or ``feature < threshold`` where ``above`` is false; ``bin`` is the threshold's number among the feature's."""

    feature: str
    above: bool
    threshold: float
    bin: int

    def holds(self, x: Column) -> Column:
        return x >= self.threshold if self.above else x < self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    verdict: int
    right: int
    wrong: int

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold:g}" for c in self.conditions) + f" -> {self.verdict} ({self.right}:{self.wrong})"


def learn_decision_list(labelled: DataFrame, label_col: str, names: tuple[str, ...] = FEATURES, bins: int = 32, most_rules: int = 8, most_conditions: int = 3, least_precision: float = 0.9, key_col: str | None = None) -> tuple[list[Rule], int]:
    """(rules in order, the verdict where none holds) learned from the rows of ``labelled`` with a label of 0 or 1; others and null features are left out.

    Thresholds are quantiles of each feature. Two thirds of the rows, by a hash, grow a rule for the rarer label among what no rule holds for yet:
    the condition of most information gain is added until no wrong row is left or none gains; the rest of the rows
    prunes it to the leading conditions that keep right against wrong best. A rule that isn't right in ``least_precision`` of
    the pruning rows ends the list. Each step is one aggregate, over all rows, into counts by feature, bin and label;
    rows of equal bins are one row with a count throughout. No rows give no rules and verdict 1.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.forall(F.array(*names), lambda x: x.isNotNull()))
    edges = rows.agg(*[F.sort_array(F.array_distinct(F.percentile_approx(c, [k / bins for k in range(1, bins)], F.lit(10_000)))).alias(c) for c in names]).first()
    if edges is None or edges[0] is None:
        return [], 1
    cuts = {c: [float(x) for x in edges[c]] for c in names}
    places = [_bin_of(F.col(c), cuts[c]).alias(c) for c in names]
    split = F.pmod(F.xxhash64(*([key_col] if key_col else names), F.lit("split")), F.lit(3)) > 0
    table = rows.select(F.col(label_col).cast("int").alias("y"), split.alias("grow"), *places).groupBy("y", "grow", *names).count()
    table = materialise(table.withColumn("all", F.array(*names)), "rules-counts")

    def inside(conditions: tuple[Condition, ...]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & ((F.col(c.feature) > c.bin) if c.above else (F.col(c.feature) <= c.bin))
        return out

    rules: list[Rule] = []
    free = F.lit(True)
    while True:
        left = {(r["grow"], r["y"]): r["n"] for r in table.where(free).groupBy("grow", "y").agg(F.sum("count").alias("n")).collect()}  # four rows
        ones, zeros = (sum(left.get((g, y), 0) for g in (True, False)) for y in (1, 0))
        common = int(ones >= zeros) if ones + zeros else (rules[-1].verdict ^ 1 if rules else 1)
        rare = 1 - common
        if not left.get((True, rare)) or not left.get((False, rare)) or len(rules) == most_rules:
            return rules, common
        grown: tuple[Condition, ...] = ()
        p, n = left.get((True, rare), 0), left.get((True, common), 0)
        while n and len(grown) < most_conditions:
            found = table.where(F.col("grow") & free & inside(grown)).select("y", "count", F.posexplode("all").alias("f", "b")).groupBy("f", "b", "y").agg(F.sum("count").alias("n")).collect()  # a row per feature, bin and label
            best = _best_condition([(r["f"], r["b"], r["y"], r["n"]) for r in found], names, cuts, rare, p, n)
            if best is None:
                break
            condition, p, n = best
            grown = (*grown, condition)
        if not grown:
            return rules, common
        sums = [F.sum(F.when((F.col("y") == y) & inside(grown[: k + 1]), F.col("count")).otherwise(0)).alias(f"c{k}_{y}") for k in range(len(grown)) for y in (0, 1)]
        kept = table.where(~F.col("grow") & free).agg(*sums).first()
        worth = [((kept[f"c{k}_{rare}"] - kept[f"c{k}_{common}"]) / max(1, kept[f"c{k}_{rare}"] + kept[f"c{k}_{common}"]), kept[f"c{k}_{rare}"], -k) for k in range(len(grown))]
        k = -max(worth)[2]
        right, wrong = kept[f"c{k}_{rare}"], kept[f"c{k}_{common}"]
        if not right or right < least_precision * (right + wrong):
            return rules, common
        rules.append(Rule(grown[: k + 1], rare, right, wrong))
        free = free & ~inside(rules[-1].conditions)


def _bin_of(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted thresholds ``x`` reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e <= x))


def _best_condition(found: list[tuple], names: tuple[str, ...], cuts: dict[str, list[float]], rare: int, p: int, n: int) -> tuple[Condition, int, int] | None:
    """The threshold of most information gain over p right and n wrong rows, with what it leaves of both; None if none gains."""
    from math import log2

    before, best = log2(p / (p + n)), None
    for f, name in enumerate(names):
        counts = {(b, y): c for g, b, y, c in found if g == f}
        below = [0, 0]
        for k, threshold in enumerate(cuts[name]):
            for y in (0, 1):
                below[y] += counts.get((k, y), 0)
            for above, right, wrong in ((False, below[rare], below[1 - rare]), (True, p - below[rare], n - below[1 - rare])):
                if right and right + wrong < p + n:
                    gain = right * (log2(right / (right + wrong)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, Condition(name, above, threshold, k), right, wrong)
    return best and best[1:]


def verdict_expression(rules: list[Rule], otherwise: int) -> Column:
    """The list as one conditional expression over the features: the first rule that holds gives its verdict (an int)."""
    columns, out = features(), None
    for rule in rules:
        holds = F.lit(True)
        for c in rule.conditions:
            holds = holds & c.holds(columns[c.feature])
        out = F.when(holds, rule.verdict) if out is None else out.when(holds, rule.verdict)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def keep_by_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """A row per document: ``id_col``, the counts of ``text_statistics``, ``base_failed`` (fewer than 50 words, or over half of them repeated) and ``kept``.

    ``labels`` rate some ids with 1 (good) or 0; an id rated in several ways counts by each. Rules are learned from rated documents that pass the base, as
    many as there are. A document stays if it passes the base and the list says 1. Null ids and repeated rows are
    documents like any other; extra columns of both tables are ignored; without labels all that pass the base stay.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    stats = materialise(text_statistics(rows, "__text").drop("__text"), "rules-stats")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rated = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__y").isin(0, 1)).distinct()
    known = stats.where(~failed).join(rated, "__id").select("__id", "__y", *[c.alias(f"f_{k}") for k, c in features().items()]).withColumnsRenamed({f"f_{k}": k for k in FEATURES})
    rules, otherwise = learn_decision_list(known, "__y", key_col="__id", **settings)
    verdict = verdict_expression(rules, otherwise)
    return stats.select(F.col("__id").alias(id_col), *[c for c in stats.columns if c != "__id"], failed.alias("base_failed"), F.when(failed, False).otherwise(verdict == 1).alias("kept"))
