"""Near-duplicate texts by shingle similarity: long SimHash codes, pigeonhole partitions with a recall target, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import materialise, spread
from loomwork.llm.components import connected_components
from loomwork.llm.simhash import _mask, dealt_blocks, group_batches, local_components

#: 64-bit words of a code, and how many of them travel with a probe to sift what shares a key.
WORDS, SIFT = 8, 2
BITS = 64 * WORDS
#: Texts of a family that are held against each other in one go; larger families are dealt in pairs of blocks.
FAMILY_BLOCK = 512
#: Pairs at the similarity asked for that the partitions may miss.
MISS = 0.01
#: Numbers of partitions that are weighed against each other.
PARTS = (28, 32, 36, 42, 51, 64)
#: Seconds that a row sent under a key and a compared pair cost, for the choice of thresholds; only their ratio matters.
ROW_COST, PAIR_COST = 2e-6, 1e-8


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """The distinct XXH64 of a whole text's shingles, sorted: A-Z lower-cased, words cut at ASCII white space; fewer words are one shingle, none give none."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or "").encode("utf-8", "surrogatepass").translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return np.zeros(0, "<u8")
    line, n = b" ".join(words), len(words) - shingle_words + 1
    if n <= 1:
        return np.array([xxh(line, 42)], "<u8")
    start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    return np.unique(np.array([xxh(line[i:j], 42) for i, j in zip(start[:n].tolist(), (start[shingle_words:] - 1).tolist(), strict=True)], "<u8"))


def long_code(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of 512 bits: word 0 has the majority of each hash bit, word k that of each bit's agreement with the k-th bit after it.

    The exclusive or of two bits of a hash is as random as a bit of another hash, so one hash a shingle does.
    """
    ones, both = np.zeros(64, np.float64), np.zeros((64, 64), np.float64)
    for at in range(0, len(hashes), 1 << 14):
        x = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
        ones += x.sum(0, dtype=np.float64)
        both += x.T @ x
    i = np.arange(64)
    bits = np.stack([ones, *[both[i, (i + k) % 64] for k in range(1, WORDS)]]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def text_codes(docs: DataFrame, text_col: str, shingle_words: int) -> DataFrame:
    """``docs`` with ``node``, equal for equal sets of shingles (0 for none), and ``code``, an array of longs."""

    @F.pandas_udf("node long, code array<long>")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest as xxh

        for texts in batches:
            rows = []
            for t in texts:
                h = shingle_hashes(t, shingle_words)
                rows.append((int(np.array(xxh(h.tobytes()) | 1, "<u8").view("<i8")) if len(h) else 0, long_code(h)))
            yield pd.DataFrame(rows, columns=["node", "code"])

    return docs.withColumn("__c", code(F.col(text_col))).select("*", "__c.node", "__c.code").drop("__c")


def bit_counts(codes: DataFrame, n: int) -> np.ndarray:
    """How many of the codes have both of each two bits, counted over all of them."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS, BITS), np.float64)
        for b in batches:
            raw = np.stack(b["code"].to_list()).astype("<i8").view(np.uint8)
            x = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
        yield pd.DataFrame({"i": np.arange(BITS, dtype=np.int32), "row": list(both.astype(np.int64))})

    few = codes.select("code").coalesce(max(1, -(-n // 500_000)))  # codes are small, the counts of a task are 512 x 512
    rows = few.mapInPandas(partial, "i int, row array<long>").select("i", F.posexplode("row").alias("j", "n"))
    sums = rows.groupBy("i", "j").agg(F.sum("n").alias("n")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "n"))).alias("row"))
    both = np.zeros((BITS, BITS))
    for r in sums.select("i", F.transform("row", lambda x: x["n"]).alias("row")).collect():  # BITS rows
        both[r["i"]] = r["row"]
    return both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width; a group gathers bits that correlate, so that others tell codes apart better."""
    p = np.diag(both) / max(n, 1)
    scale = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), scale, out=np.zeros_like(both), where=scale > 0))
    np.fill_diagonal(corr, 0)
    free, groups = np.ones(len(p), bool), []
    for k in range(parts):
        left = np.flatnonzero(free)
        group = [int(left[corr[np.ix_(left, left)].sum(1).argmax()])]
        free[group[0]] = False
        while len(group) < len(left) // (parts - k):
            left_now = np.flatnonzero(free)
            group.append(int(left_now[corr[np.ix_(left_now, group)].sum(1).argmax()]))
            free[group[-1]] = False
        groups.append(sorted(group))
    return groups


def spread_of(chances: np.ndarray, most: int) -> np.ndarray:
    """The probability of 0 to ``most`` successes among events of these chances."""
    at = np.zeros(most + 1)
    at[0] = 1.0
    for q in chances:
        at[1:] = at[1:] * (1 - q) + at[:-1] * q
        at[0] *= 1 - q
    return at


def thresholds_for_recall(n: int, p: np.ndarray, groups: list[list[int]], differ: float, miss: float = MISS) -> tuple[float, list[int]]:
    """(cost, threshold of each group) of least estimated cost so that all groups together miss a pair, whose bits differ with chance ``differ``, at most with chance ``miss``.

    -1 leaves a group out, 0 sends a code under its own key, 1 also under those that differ in one bit: codes then
    meet when they differ in two. Dynamic programming over groups and the sum of -log of what each misses.
    """
    step, goal = 0.02, -math.log(miss)
    states = math.ceil(goal / step)
    best, chosen = np.full(states + 1, np.inf), [[] for _ in range(states + 1)]
    best[0] = 0.0
    for bits in groups:
        w = len(bits)
        near, random = spread_of(np.full(w, differ), 2), spread_of(2 * p[bits] * (1 - p[bits]), 2)
        pairs = n * (n - 1) / 2
        options = [(-1, 0.0, 0.0), (0, near[0], n * ROW_COST + pairs * random[0] * PAIR_COST), (1, near.sum(), n * (w + 1) * ROW_COST + pairs * ((w + 1) * random[0] + 2 * random[1] + 2 * random[2]) * PAIR_COST)]
        new, lists = np.full(states + 1, np.inf), [[] for _ in range(states + 1)]
        for t, found, cost in options:
            gain = min(states, int(-math.log(max(1 - found, 1e-12)) / step))
            for s in range(states + 1):
                to = min(states, s + gain)
                if best[s] + cost < new[to]:
                    new[to], lists[to] = best[s] + cost, [*chosen[s], t]
        best, chosen = new, lists
    return float(best[states]), chosen[states]


def _keys(groups: list[list[int]], thresholds: list[int]) -> Column:
    """All keys of a row's ``code``: of each group used a hash of its bits, and with threshold 1 of the same with each bit turned."""
    out = []
    for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        masks = [_mask([b % 64 for b in bits if b // 64 == k]) for k in range(WORDS)]
        words = [F.get("code", F.lit(k)).bitwiseAND(F.lit(m).cast("long")) for k, m in enumerate(masks)]
        out.append(F.xxhash64(F.lit(i), *words))
        if t:
            out += [F.xxhash64(F.lit(i), *[w.bitwiseXOR(F.lit(_mask([b % 64])).cast("long")) if k == b // 64 else w for k, w in enumerate(words)]) for b in bits]
    return F.array(*out)


def shortest_forest(n: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the edges a-b form a spanning forest of least total length (Boruvka's rounds)."""
    label, live, chosen = np.arange(n), np.arange(len(a)), []
    weight = apart.astype(np.int64) * max(1, len(a)) + np.arange(len(a))
    while len(live):
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, label[a[live]], weight[live])
        np.minimum.at(best, label[b[live]], weight[live])
        picked = np.unique(best[best < np.iinfo(np.int64).max]) % max(1, len(a))
        chosen.append(picked)
        label = local_components(n, label[a[picked]], label[b[picked]])[label]
        live = live[label[a[live]] != label[b[live]]]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col``, ``node`` and ``component_id`` for every row: texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more are linked.

    Texts with equal sets are one node. Codes of 512 bits are cut into partitions of correlated bits; dynamic
    programming allots each partition its own threshold, by estimated candidate counts, so that a pair at the similarity asked for is missed
    by all of them with a chance of 1 %; more similar pairs less. What shares a key is sifted by 128 bits; each block of compared codes gives a
    spanning forest, so that all candidates lie in one family. Inside a family every two texts are then held against each other on the
    shingles themselves, in blocks: no link is wrong, and none between candidates is lost. A component's
    id is the least id in it; components as in ``simhash_components``: null ids never name one, empty texts are one node, an empty table gives an empty one.
    """
    rows, named = _components(docs, id_col, text_col, shingle_words, similarity)
    return rows.select("__id", "node").join(named, "node").select(F.col("__id").alias(id_col), "node", "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(``__id``, ``__k``, ``node`` of each row; ``node``, ``component_id`` and ``label``, one of each component's own, of each node)."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = text_codes(rows.withColumn("__k", F.xxhash64("__id", "__text")), "__text", shingle_words)
    rows = materialise(rows.select("__id", "__k", "node", "code"), "near-codes")
    nodes = materialise(rows.groupBy("node").agg(F.min("__id").alias("__least"), F.min("__k").alias("__k"), F.first("code").alias("code")), "near-nodes")
    live = nodes.where("node != 0")
    n = live.count()
    linked = _linked(docs, id_col, text_col, nodes, live, n, shingle_words, similarity) if n > 1 else live.select("node", F.col("node").alias("component")).limit(0)
    label = F.when(F.col("component").isNull(), F.xxhash64("node", F.lit("alone"))).otherwise(F.xxhash64("component", F.lit("linked")))
    named = materialise(nodes.join(linked.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("node", "__least", label.alias("label")), "near-named")
    least = materialise(named.groupBy("label").agg(F.min("__least").alias("component_id")), "near-least")
    return rows, materialise(named.join(least, "label").select("node", "component_id", "label"), "near-components")


def _linked(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, live: DataFrame, n: int, shingle_words: int, similarity: float) -> DataFrame:
    """``node`` and ``component`` of the nodes that have verified links."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of the bits, for sets of equal size
    families = connected_components(_candidates(live, n, differ)).withColumnRenamed("component", "family")
    sets = _shingle_sets(docs, id_col, text_col, families.join(nodes.select("node", "__k"), "node"), shingle_words)
    return connected_components(_verified(sets, similarity))


def _reach(bits: int, differ: float) -> int:
    """How many of ``bits`` bits may differ for a pair to be looked at further: next to no pair at the similarity asked for has more."""
    return int(bits * differ + 3.5 * math.sqrt(bits * differ * (1 - differ)))


def _candidates(live: DataFrame, n: int, differ: float) -> DataFrame:
    """(a, b): nodes whose codes are near, a spanning forest of each block that was compared."""
    both = bit_counts(live, n)
    p = np.diag(both) / n
    plans = [(*thresholds_for_recall(n, p, groups, differ), groups) for groups in (group_bits(n, both, g) for g in PARTS)]
    _, thresholds, groups = min((x for x in plans if math.isfinite(x[0])), key=lambda x: x[0])
    reach = _reach(64 * SIFT, differ)
    keyed = live.select("node", *[F.get("code", F.lit(k)).alias(f"f{k}") for k in range(SIFT)], F.explode(_keys(groups, thresholds)).alias("key"))
    dealt = dealt_blocks(keyed, ["key"], F.col("node"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in group_batches(batches):
            g, node = x["__g"].to_numpy("i8"), x["node"].to_numpy("i8")
            f = [x[f"f{k}"].to_numpy("i8") for k in range(SIFT)]
            at, lag, ends = np.arange(len(g)), 0, []
            while len(at):
                lag += 1
                at = at[at + lag < len(g)]
                at = at[g[at] == g[at + lag]]
                apart = sum(np.bitwise_count(np.bitwise_xor(v[at], v[at + lag]).view(np.uint64)).astype(np.int16) for v in f)
                hit = np.flatnonzero((apart <= reach) & (node[at] != node[at + lag]))
                if len(hit):
                    ends.append((at[hit], at[hit] + lag, apart[hit]))
                if sum(len(e[0]) for e in ends) > 1 << 20:  # a forest of what there is takes less memory, and the forest of both is the same
                    ends = [_shortest(len(g), ends)]
            if ends:
                a, b, apart = _shortest(len(g), ends)
                yield pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    def _shortest(size: int, ends: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, apart = (np.concatenate([e[i] for e in ends]) for i in range(3))
        kept = shortest_forest(size, a, b, apart)
        return a[kept], b[kept], apart[kept]

    found = spread(dealt.select("__g", "node", *[f"f{k}" for k in range(SIFT)]), "__g").sortWithinPartitions("__g").mapInPandas(compare, "a long, b long")
    return materialise(found.distinct(), "near-candidates")


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """``node``, ``family`` and ``shingles`` (sorted hashes as bytes) of the wanted nodes; only their texts are read again, one for each node."""

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, shingle_words).tobytes() for t in texts])

    own = docs.select(F.col(text_col).alias("__text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("__k"))
    texts = own.join(wanted.hint("shuffle_hash"), "__k").groupBy("node").agg(F.min("__text").alias("__text"), F.first("family").alias("family"))
    return materialise(texts.select("node", "family", hashes("__text").alias("shingles")), "near-shingles")


def common_shingles(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many hashes each two sets share: products of 0/1 matrices over the hashes that are in several sets, some columns at a time."""
    n = len(sets)
    row, all_ = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    _, place, count = np.unique(all_, return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    keep = several[place]
    row, col = row[keep], number[place[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(several.sum()), columns):
        lo, hi = np.searchsorted(col, [at, at + columns])
        m = np.zeros((n, columns), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        out += m @ m.T
    return out.astype(np.float64)


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) that connect what verified links connect: in each pair of blocks of a family all pairs are held against each other, and a forest of the links comes out."""
    dealt = dealt_blocks(sets, ["family"], F.col("node"), FAMILY_BLOCK)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in group_batches(batches, 2_000):
            for _, g in x.groupby("__g", sort=False):
                if len(g) < 2:
                    continue
                node, own = g["node"].to_numpy("i8"), [np.frombuffer(s, "<u8") for s in g["shingles"]]
                size, common = np.array([len(s) for s in own]), common_shingles(own)
                i, j = np.nonzero(np.triu(common / np.maximum(1, size[:, None] + size[None] - common) >= similarity, 1))
                label = local_components(len(g), i, j)
                moved = np.flatnonzero(label != np.arange(len(g)))
                if len(moved):
                    yield pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    return materialise(spread(dealt.select("__g", "node", "shingles"), "__g").sortWithinPartitions("__g").mapInPandas(compare, "a long, b long").distinct(), "near-edges")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of similar texts, of the least id and then the least hash of id and text.

    Ids may repeat: a text is never lost because another has its id. Of a component whose ids are all null all rows stay.
    """
    rows, named = _components(docs, id_col, text_col, shingle_words, similarity)
    return keep_one_of_each(docs, id_col, text_col, rows.select("__id", "__k", "node").join(named, "node"))


def keep_one_of_each(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``label`` of ``rows`` (``__id``, ``__k``: the hash of id and text); all rows of labels without an id."""
    best = rows.groupBy("label").agg(F.min(F.when(F.col("__id").isNotNull(), F.struct("__id", "__k"))).alias("x"))
    keep = materialise(best.where("x is not null").select(F.col("x.__k").alias("__keep")).distinct(), "keep-one")
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    kept = docs.where(F.col(id_col).isNotNull()).withColumn("__k", key).join(keep, F.col("__k") == F.col("__keep"), "left_semi").dropDuplicates(["__k"]).drop("__k")
    nameless = best.where("x is null")
    if nameless.isEmpty():
        return kept
    all_null = materialise(rows.join(nameless.select("label"), "label").select(F.col("__k").alias("__keep")).distinct(), "keep-all")
    return kept.unionByName(docs.where(F.col(id_col).isNull()).withColumn("__k", key).join(all_null, F.col("__k") == F.col("__keep"), "left_semi").drop("__k"))
