"""Line dedup, mixing, SimHash, packing and the url cascade against plain versions, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from loomwork.llm import line_dedup, mixing, packing, simhash, url_cascade
from loomwork.llm.queries import URL_RULES, tokenizer_file

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- line dedup ----


def plain_dedup(texts, least=50):
    """Straight from the definition: every run of ``least`` words or more that occurred earlier goes."""
    import re

    first, runs, out = {}, [], []
    cut = [re.sub(r"(\n|[.!?] )", "\\1\x00", t or "").split("\x00") for t in texts]
    for d, lines in enumerate(cut):
        some = [(i, x.translate(str.maketrans("\n\r\t", "   ")).strip(" "), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(lines)]
        some = [x for x in some if x[2]]
        for a in range(len(some)):
            n = 0
            for b in range(a, min(len(some), a + 150)):
                n += some[b][2]
                if n >= least:
                    key = tuple(x[1] for x in some[a : b + 1])
                    runs.append((d, some[a][0], some[b][0], key))
                    first.setdefault(key, (d, some[b][0]))
                if n >= 3 * least:  # longer runs are covered by shorter ones
                    break
    gone = {(d, i) for d, a, b, key in runs if first[key][0] != d or a > first[key][1] for i in range(a, b + 1)}
    for d, (t, lines) in enumerate(zip(texts, cut, strict=True)):
        out.append(None if t is None else "".join(x for i, x in enumerate(lines) if (d, i) not in gone))
    return out


def test_line_dedup_equals_definition(spark):
    rng = random.Random(1)
    passages = [". ".join(words(rng, rng.randint(4, 15)) for _ in range(9)) + "." for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randint(1, 20)) + rng.choice([".", "\n", "! ", "\n\n"]) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages) + rng.choice([" ", "\n"]))
        texts.append(" ".join(parts))
    texts += [None, "", "   \n\n ", "one two. " * 120, "x" * 5000 + " y" * 3000, texts[3], "mark \x01 here. " + passages[0]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_dedup(texts)
    assert any(got[i] != t for i, t in enumerate(texts))


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    t = "a b. " * 60
    d = spark.createDataFrame([(None, t, 1), (None, t, 1), (5, t, 2)], "doc_id long, text string, removed_lines int")
    out = sorted((r["doc_id"] is not None, len(r["text"])) for r in line_dedup.dedup_lines(d).collect())
    assert out[0] == out[1] and out[2] == (True, 0)  # equal rows are one document and come first; the later one is emptied


def test_line_dedup_deletes_runs_to_their_ends(spark):
    rng = random.Random(12)
    run = [words(rng, n) + ". " for n in (30, 25, 10, 10)]
    texts = ["".join(run) + "own end.", "another start. " + "".join(run) + "another end."]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "another start. another end."}  # windows from a line on would leave the last 20 words
    passages = [[words(rng, rng.randint(2, 30)) + rng.choice([". ", "\n", ".\n\n"]) for _ in range(14)] for _ in range(5)]
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            x, a = rng.choice(passages), rng.randint(0, 8)
            parts += [words(rng, rng.randint(1, 20)) + ". "] + x[a : a + rng.randint(2, 14)]
        texts.append("".join(parts))
    texts += ["one two. " * 70, "", texts[5]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_dedup(texts)


def test_line_dedup_of_repeated_rows(spark):
    rng = random.Random(11)
    passage = ". ".join(words(rng, rng.randint(6, 12)) for _ in range(12)) + ". "
    texts = [passage + words(rng, 9) + ".", words(rng, 8) + ". " + passage + words(rng, 7) + ".", "own words. " + passage + passage]
    d = docs(spark, texts)
    out = line_dedup.dedup_lines(d.union(d).union(d)).groupBy("doc_id", "text").count().collect()
    assert {r["doc_id"]: r["text"] for r in out} == dict(enumerate(plain_dedup(texts))) and [r["count"] for r in out] == [3, 3, 3]


# ---- mixing ----


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(400)] + [None, "", "solo"]
    sources = [rng.choice(["a", "b", "c", "d", None, "é"] + ["hot"] * 4) for _ in texts]
    rows = mixing.mix_sources(docs(spark, texts, sources)).collect()
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = plain_targets(sizes)
    longest = max(len((t or "").split()) for t in texts)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(targets[s] - longest <= taken[s] <= targets[s] + 1e-6 for s in targets)
    again = mixing.mix_sources(docs(spark, texts, sources).repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def words_near_targets(d):
    """Taken words by source; asserts that they miss the targets by less than the longest document."""
    rows = mixing.mix_sources(d).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    targets, longest = plain_targets(sizes), max(r["size"] for r in rows)
    assert all(targets[s] - longest < taken[s] <= targets[s] + 1e-6 for s in targets), (targets, taken)
    return taken


def test_mixing_meets_targets_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    texts = [words(rng, rng.randint(0, 9)) for _ in range(900)]
    sources = [rng.choice("abc") for _ in texts]
    words_near_targets(docs(spark, texts, sources, [None if i % 2 else i for i in range(900)]))
    words_near_targets(docs(spark, texts, sources, [i % 7 for i in range(900)]))
    # one document is most of its source, with a null id, and is counted out
    same = docs(spark, [*(["five words in each copy"] * 600), *texts], [*(["c"] * 600), *sources], [None] * 1500)
    taken = words_near_targets(same)
    assert taken == words_near_targets(same.repartition(7))
    words_near_targets(docs(spark, ["a b"] * 40, ["x"] * 13 + ["y"] * 27, [1] * 40))


def test_mixing_edges(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(docs(spark, [None, ""])).collect()] == [0, 0]
    d = docs(spark, ["a b"] * 6, ["x"] * 6, [1, 1, 1, None, None, 2]).withColumnsRenamed({"lang": "size", "n_chars": "target"})
    assert [r["taken"] for r in mixing.mix_sources(d).collect()] == [2] * 6
    kept = mixing.mixed_documents(d)
    assert kept.columns == d.columns and kept.count() == 6


# ---- SimHash ----


def plain_print(text, k=3):
    w = (text or "").encode("utf-8").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s)) if s else 0


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    base = [words(rng, rng.randint(2, 300)) for _ in range(80)]
    texts = list(base) + [None, "", " \t", "One", "ONE two", "one\vtwo\x1cthree"]
    for t in base[:50]:
        w = t.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts += [base[0]] * 30
    prints = [plain_print(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [(p, root(i)) for i, p in enumerate(prints)]
    assert len({root(i) for i in range(len(texts))}) < len(texts) - 30
    kept = simhash.drop_near_duplicates(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in range(len(texts))})


def test_dense_bucket_is_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash.dealt_blocks, "__defaults__", (16,))
    rng = np.random.default_rng(4)
    chain, x = [], 0
    for i in range(200):  # each step flips two of ten bits: one dense group
        x ^= (1 << int(rng.integers(10))) ^ (1 << int(rng.integers(10)))
        chain.append(x)
    far = [int(v) for v in rng.integers(1 << 62, size=100)]
    values = sorted(set(chain + far))
    edges = [(r["a"], r["b"]) for r in simhash.hamming_edges(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 10 for a, b in edges)

    def classes(pairs):
        p = {v: v for v in values}

        def root(v):
            while p[v] != v:
                v = p[v]
            return v

        for a, b in pairs:
            p[max(root(a), root(b))] = min(root(a), root(b))
        return {v: root(v) for v in values}

    assert classes(edges) == classes([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])


def test_thresholds_keep_the_pigeonhole_sum():
    costs = [[0, 5, 50, 500, 5000], [0, 1, 10, 100, 1000], [0, 900, 9e3, 9e4, 9e5], [0, 2, 20, 200, 2000]]
    t = simhash.allocate_thresholds(costs, 3)
    assert sum(t) == 3 - 4 + 1 and t[2] == -1


def test_simhash_edges(spark):
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0
    rows = simhash.simhash_components(docs(spark, ["a b c d"] * 3 + [None], ids=[None, None, 7, 8])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in rows) == [("7", 7), ("8", 8), ("None", 7), ("None", 7)]


# ---- packing ----


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [words(rng, rng.choice([1, 3, 30, 200, 900])) for _ in range(150)] + [None, "", " ", "a  b \n c ", "<|endoftext|> x", "z" * 9000, "tab\t x \t y ", "é" * 40 + " 's don't"]
    rows = packing.pack_documents(docs(spark, texts), tokenizer_file()).collect()
    tok = Tokenizer.from_file(tokenizer_file())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and 0 < r["length"] <= 1024 and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(by[i]) == 1)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 1024) * 1.02 + 2


def fewest_bins(x, capacity):
    """What no packing undercuts: a bin for each piece over half, and of those from t to a half, what the gaps beside them can't hold."""
    large = x[x > capacity // 2]
    by_count = [len(large) + max(0, -(-int(((x >= t) & (x <= capacity // 2)).sum() - ((capacity - large) // t).sum()) // (capacity // t))) for t in range(1, capacity // 2 + 1)]
    return max(-(-int(x.sum()) // capacity), *by_count)


def best_fit(x, capacity):
    gaps = np.zeros(capacity + 1, int)
    for n in np.sort(x)[::-1]:
        g = next((g for g in range(n, capacity + 1) if gaps[g]), 0)
        gaps[g] -= bool(g)
        gaps[(g or capacity) - n] += 1
    return int(gaps.sum())


@pytest.mark.parametrize("longest", [1024, 600, 300])
def test_sum_of_squares_packs_tightly(longest):
    for seed in range(6, 10):
        x = np.random.default_rng(seed).integers(1, longest + 1, 4096)
        where, offset, n = packing.sum_of_squares(x, 1024)
        assert n <= fewest_bins(x, 1024) * 1.003 + 1 and n <= best_fit(x, 1024)
        assert np.bincount(where, x, n).max() <= 1024 and np.bincount(where, minlength=n).min() > 0
        order = np.lexsort((offset, where))
        ends = (offset + x)[order]
        assert ((offset[order][1:] == 0) | (offset[order][1:] == ends[:-1])).all() and offset[order][0] == 0


def test_packing_deals_equal_rows_to_many_groups(spark):
    from pyspark.sql import functions as F

    d = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit(1).alias("piece"), F.lit(2).alias("offset"))
    out = packing.pack_documents(d, tokenizer_file())
    groups = [r["count"] for r in out.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()]
    assert sum(groups) == 60_000 and max(groups) < 2 * packing.GROUP_PIECES
    assert out.select("sequence_id", "offset").distinct().count() == 60_000 and out.columns[0] == "doc_id"


def test_packing_edges(spark):
    assert packing.pack_documents(docs(spark, []), tokenizer_file()).count() == 0
    d = docs(spark, ["a"] * 4, ids=[None, None, 1, 1])
    rows = packing.pack_documents(d, tokenizer_file()).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None", "None"] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


# ---- url cascade ----


def plain_judge(url):
    import re

    m = re.match(r"(?s).*?://(.*)$", url or "")
    rest = m[1] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^/?#]*([^?#]*)", rest)[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://EXAMPLE.com/en/1", "https://www.example.com/en/2?x", "http://a.www.example.com/en/", "http://x.net/es/1#t", "x.net/es/", "http://net/fr/", "http://com/", "http://com", "ftp://a.b.COM/?q", "http://xcom/",
    "http://example.com/en", "http://example.com/En/", "http://a.com/b://c.net/es/", "http:///en/", "http://example.com?/en/", "http://examplé.com/ü/é", "http://example.com./en/", "http://net/es", "http://user@ex.net/es/x" + "y" * 5000, "http://a\nb.com/\nen/",
]


def test_url_rules_equal_plain(spark):
    rng = random.Random(7)
    urls = URLS + [f"http://{rng.choice(['www.', '', 'm.'])}{rng.choice(['example', 'ex'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}{rng.choice(['/', ''])}{i}" for i in range(300)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("url", "url")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge_urls(d, rules).collect()}
    assert [got[i] for i in range(len(urls))] == [plain_judge(u) for u in urls]


def keys_frame(spark, x):
    return spark.createDataFrame([(k,) for k in x], "key string")


@pytest.mark.parametrize("most_words", [1 << 15, 4])
def test_cascade_is_exact_on_its_universe(spark, monkeypatch, most_words):
    from pyspark.sql import functions as F

    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(6000)]
    monkeypatch.setattr(url_cascade, "MOST_WORDS", most_words)
    monkeypatch.setattr(url_cascade.BloomCascade, "level_bits", staticmethod(lambda a, b: (1, 2)))
    c = url_cascade.BloomCascade(keys_frame(spark, keys[:500]), keys_frame(spark, keys))
    assert len(c.levels) >= 3 and (c.shards > 1) == (most_words == 4)
    got = {r["key"] for r in c.with_filters(keys_frame(spark, keys)).where(c.contains(F.col("key"))).collect()}
    assert got == set(keys[:500])


def test_large_lists_are_asked_through_their_filters(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "MOST_WORDS", 1)
    rng = random.Random(9)
    hosts = [f"{rng.choice(['a', 'b', 'www'])}.h{i % 40}.{rng.choice(['com', 'net', 'org'])}" for i in range(300)]
    rules = [(h, rng.choice(["/", "/en/", "", None]), rng.choice(["allow", "block", "hold"])) for h in hosts[:120]] + [("com", "/", "allow")]
    urls = [f"http://{h}/{rng.choice(['en/', 'es/', ''])}{i}" for i, h in enumerate(hosts)] + [None, "x", "http://com"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_cascade.judge_urls(d, frame).collect()}
    verdicts = {}
    for h, p, v in rules:
        verdicts[h, p or ""] = min(v, verdicts.get((h, p or ""), v))
    for i, u in enumerate(urls):
        host, path, *_ = plain_judge(u)
        best = max(((len(h + p), h + p, v) for (h, p), v in verdicts.items() if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert got[i] == best[1:]


def test_any_number_of_verdicts(spark, monkeypatch):
    rules = spark.createDataFrame([(f"h{i}.com", "/", f"v{i}") for i in range(20)] + [("com", "/", "rest")], "host string, path string, verdict string")
    d = spark.createDataFrame([(i, f"http://www.h{i}.com/x") for i in range(22)] + [(99, "http://a.net/")], "page_id long, url string")
    want = {**{i: f"v{i}" for i in range(20)}, 20: "rest", 21: "rest", 99: "allow"}
    for most in (1000, 2):
        monkeypatch.setattr(url_cascade, "MOST_NAMES", most)
        assert {r["page_id"]: r["verdict"] for r in url_cascade.judge_urls(d, rules).collect()} == want


def test_very_long_urls(spark):
    import time

    rules = spark.createDataFrame([*URL_RULES, ("com", "nowhere", "block")], "host string, path string, verdict string")
    d = spark.createDataFrame([(1, f"http://{'a.' * 200_000}com/x"), (2, f"http://www.example.com/en/{'y' * 500_000}?{'z' * 10_000}"), (3, "http://comnowhere")], "page_id long, url string")
    began = time.time()
    got = {r["page_id"]: (len(r["host"]), len(r["path"]), r["rule"], r["verdict"]) for r in url_cascade.judge_urls(d, rules).collect()}
    assert got == {1: (400_003, 2, "com/", "allow"), 2: (15, 500_004, "www.example.com/en/", "allow"), 3: (10, 0, None, "allow")}
    assert time.time() - began < 60


def test_url_edges(spark):
    rules = spark.createDataFrame([("com", None, "block"), (None, "/", "allow")], "host string, path string, verdict string")
    d = spark.createDataFrame([(1, "http://a.com", "x"), (None, None, "y")], "page_id long, url string, verdict string")
    assert sorted((r["rule"] or "", r["verdict"]) for r in url_cascade.judge_urls(d, rules).collect()) == [("", "allow"), ("com", "block")]
    assert url_cascade.judge_urls(d.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_cascade.judge_urls(d, rules.limit(0)).collect()} == {"allow"}
