"""Quality rules: counts against plain ones, the learner against plain covering, planted rules."""

import random
import re
from collections import Counter
from math import log2

from pyspark.sql import functions as F

from loomwork.llm.decision_list import FEATURES, features, keep_by_rules, learn_decision_list, text_statistics, verdict_expression

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \t\n", "a", "a b c", "a b c a b c", "a a a a a a", "a b c d a b c e\na b c d a b c e\n\n \n", "x | y <tag> & $5 *#%\r\nx | y <tag> & $5 *#%\r\nend",
    "ÄÖ ü　wide 😀 emoji\v\f x", "one two three " * 4000, " ".join(str(i) for i in range(30_000)), "line\nline \nline", "A. B! C? {d}\n" * 3,
]


def counts(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {k for i, x in enumerate(windows) if often[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain(spark):
    r = random.Random(1)
    texts = TEXTS + [r.choice(["\n", " "]).join(r.choice("abcd") for _ in range(r.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("n", F.lit(1)).withColumn("h", F.lit("x"))
    rows = text_statistics(df).collect()
    assert {r.i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: counts(t) for i, t in enumerate(texts)}


def grown_plain(rows, names, bins, least_precision, most_rules, most_conditions):
    """Covering by going through the rows: (y, grow, values)."""
    edges = {}
    for f in names:
        x = sorted(r[2][f] for r in rows)
        edges[f] = sorted({x[max(0, -(-len(x) * k // bins) - 1)] for k in range(1, bins)})
    test = lambda c, v: (v[c[0]] >= c[2]) == c[1]
    rules, left = [], rows
    while True:
        ones, zeros = sum(r[0] for r in left), sum(1 - r[0] for r in left)
        rare = 1 - int(ones >= zeros)
        grow, prune = [r for r in left if r[1]], [r for r in left if not r[1]]
        if not any(r[0] == rare for r in grow) or not any(r[0] == rare for r in prune) or len(rules) == most_rules:
            return rules, 1 - rare
        conj = []
        while len(conj) < most_conditions and any(r[0] != rare for r in grow):
            p, best = sum(r[0] == rare for r in grow), None
            for f in names:
                for e in edges[f]:
                    for above in (False, True):
                        inside = [r for r in grow if test((f, above, e), r[2])]
                        right = sum(r[0] == rare for r in inside)
                        if right and len(inside) < len(grow):
                            gain = right * (log2(right / len(inside)) - log2(p / len(grow)))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, (f, above, e), inside
            if best is None:
                break
            conj.append(best[1])
            grow = best[2]
        if not conj:
            return rules, 1 - rare
        worth = []
        for k in range(1, len(conj) + 1):
            inside = [r for r in prune if all(test(c, r[2]) for c in conj[:k])]
            right = sum(r[0] == rare for r in inside)
            worth.append(((2 * right - len(inside)) / max(1, len(inside)), right, -k, len(inside)))
        _, right, k, n = max(worth)
        if not right or right < least_precision * n:
            return rules, 1 - rare
        rules.append((conj[:-k], rare))
        left = [r for r in left if not all(test(c, r[2]) for c in conj[:-k])]


def test_learner_equals_plain_covering(spark):
    r = random.Random(5)
    rows = []
    for i in range(900):
        a, b, c = r.random(), float(r.randint(0, 6)), r.random()
        y = 0 if a > 0.8 and b >= 2 or c < 0.1 else 1
        rows.append((i, y if r.random() > 0.02 else 1 - y, a, b, c))
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double")
    grow = {x.id: x.g for x in df.select("id", (F.pmod(F.xxhash64("id", F.lit("split")), F.lit(3)) > 0).alias("g")).collect()}
    want, default = grown_plain([(y, grow[i], {"a": a, "b": b, "c": c}) for i, y, a, b, c in rows], ("a", "b", "c"), 16, 0.8, 6, 3)
    got, otherwise = learn_decision_list(df, "y", ("a", "b", "c"), bins=16, most_rules=6, least_precision=0.8, key_col="id")
    assert [([(c.feature, c.above, c.threshold) for c in x.conditions], x.verdict) for x in got] == want and otherwise == default
    assert len(got) >= 2


def test_no_labels_one_label_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "id long, y int, a double")
    assert learn_decision_list(df.limit(0), "y", ("a",)) == ([], 1)
    assert learn_decision_list(df, "y", ("a",)) == ([], 1)
    assert learn_decision_list(spark.createDataFrame([(1, None, 0.5), (2, 5, 1.0), (3, 0, None), (4, 0, 2.0)], df.schema), "y", ("a",)) == ([], 0)


def test_documents_kept(spark):
    """Junk with signs goes, clean documents stay, the base goes first; odd rows have a defined verdict."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 9)))
    clean = lambda: " ".join(word() for _ in range(r.randint(60, 120)))
    docs = [(i, clean() if i % 4 else " ".join(w + "***" for w in clean().split()), "en") for i in range(400)]
    docs += [(None, clean(), "en"), (500, None, "en"), (501, "too short", "en"), (502, "a b c " * 100, None), (3, clean(), "en")]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (7, None, 0), (9, 3, 1), (8, 0, 1), (8, 0, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, quality string").withColumn("n_words", F.lit(-1))
    out = keep_by_rules(d, spark.createDataFrame(labels, "doc_id long, quality int, kept int")).collect()
    assert len(out) == len(docs)
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.kept) for x in out) == sorted([(i, i % 4 > 0) for i in range(400)] + [(-1, True), (500, False), (501, False), (502, False), (3, True)])
    assert {x.doc_id for x in out if x.base_failed} == {500, 501, 502}
    empty = keep_by_rules(d.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert empty.count() == 0
    unrated = keep_by_rules(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert unrated.where("kept != (not base_failed)").count() == 0


def test_no_python_in_the_plan(spark):
    rows = text_statistics(spark.createDataFrame([(1, "a b")], "i int, text string")).withColumns({f"f_{k}": v for k, v in features().items()})
    plan = rows.withColumn("v", verdict_expression([], 1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and len(features()) == len(FEATURES)
