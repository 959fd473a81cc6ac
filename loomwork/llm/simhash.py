"""SimHash near-duplicates with generalised pigeonhole search over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import join_small, materialise, spread
from loomwork.llm.components import connected_components

BITS = 64
#: Keys with more fingerprints than this are cut into blocks, and pairs of blocks are dealt out.
BLOCK = 1024


def fingerprints(docs: DataFrame, text_col: str = "text", shingle_words: int = 3, out_col: str = "fp") -> DataFrame:
    """``docs`` with the SimHash of each whole text as a long in ``out_col``.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are runs of
    ``shingle_words`` words joined by a space, repeats included; a shorter text is one shingle; a text
    without words, or a null one, has fingerprint zero. A bit is 1 if it is set in over half of the
    shingles' XXH64 (UTF-8, seed 42).
    """

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xxhash import xxh64_intdigest as xxh

        fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
        chunk = 1 << 16  # shingles whose bits are unpacked at a time

        def digest(text) -> int:
            if text is None:
                return 0
            words = text.encode("utf-8", "surrogatepass").translate(fold).split()  # bytes.split cuts at exactly these six characters
            n = len(words) - shingle_words + 1
            if not words:
                return 0
            line = b" ".join(words)
            if n <= 1:
                hashes = [xxh(line, 42)]
            else:
                size = np.fromiter(map(len, words), np.int64, len(words)) + 1
                start = np.concatenate([[0], np.cumsum(size)])
                begins, ends = start[:n].tolist(), (start[shingle_words:] - 1).tolist()
                hashes = [xxh(line[i:j], 42) for i, j in zip(begins, ends, strict=True)]
            ones = np.zeros(BITS, np.int64)
            for i in range(0, len(hashes), chunk):
                part = np.array(hashes[i : i + chunk], "<u8")
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            bits = (2 * ones > len(hashes)).astype(np.uint8)
            return int(np.packbits(bits, bitorder="little").view("<i8")[0])

        for texts in batches:
            yield pd.Series([digest(t) for t in texts], dtype="int64")

    return docs.withColumn(out_col, simhash(F.col(text_col)))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows of ``prints`` (column ``fp``) and how many have both of each two bits, counted over all."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            raw = b["fp"].to_numpy("<i8")
            x = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)
            n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both.ravel(), n)})

    rows = prints.select("fp").mapInPandas(partial, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width; each group collects the bits that correlate most.

    Redundancy then gathers in few groups, and the others tell fingerprints apart better.
    """
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.abs(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def allocate_thresholds(costs: list[list[float]], radius: int) -> list[int]:
    """A threshold from -1 (unused) to ``radius`` for each part, of least total cost, that misses no pair.

    By the general pigeonhole principle thresholds that sum to radius - parts + 1 suffice.
    ``costs[i][t]`` is the cost of part i at threshold t - 1. Dynamic programming over parts and sums.
    """
    parts = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(parts):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                c = cost + costs[i][t + 1]
                if total + t not in nxt or c < nxt[total + t][0]:
                    nxt[total + t] = (c, [*chosen, t])
        best = nxt
    return best[radius - parts + 1][1]


def masks(bits: list[int], most: int) -> list[int]:
    """Signed 64-bit masks of at most ``most`` of these bits."""
    from itertools import combinations

    out = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def probe_keys(prints: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """Rows (part, key, fp): a fingerprint under its own key and all keys within the part's threshold."""
    out = None
    for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        key = own if t == 0 else F.explode(F.transform(F.array(*[F.lit(m) for m in masks(bits, t)]), lambda m: own.bitwiseXOR(m)))
        rows = prints.select(F.lit(i).alias("part"), key.alias("key"), "fp")
        out = rows if out is None else out.union(rows)
    return out


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def dealt_blocks(rows: DataFrame, key: list[str], salt, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``__g``, a group to compare within: one for a small key, one per pair of blocks for a large one.

    Keys of more than ``block`` rows are found by a pre-aggregated count. Their rows are cut into
    blocks of about that size by a hash, and each row goes to every pair of blocks that has its own, so
    that no group grows with a hot key and every two rows meet.
    """
    hot = materialise(rows.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("__n")), "blocks-hot")
    out = join_small(rows, hot, key, "left", salt=salt)
    mine = F.pmod(F.xxhash64(salt, F.lit("block")), F.col("__n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda o: F.xxhash64(*key, F.least(o, mine), F.greatest(o, mine)))
    return out.withColumn("__g", F.explode(F.when(F.col("__n").isNull(), F.array(F.xxhash64(*key, F.lit("all")))).otherwise(pairs))).drop("__n")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def group_batches(batches: Iterator[pd.DataFrame], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Batches sorted by ``__g``, re-cut so that no group is in two of them."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) < least:
            continue
        x = pd.concat(held, ignore_index=True) if len(held) > 1 else b
        g = x["__g"].to_numpy()
        cut = len(g) - int(np.argmax(g[::-1] != g[-1])) if (g != g[-1]).any() else 0
        if cut:
            yield x.iloc[:cut]
        held = [x.iloc[cut:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def hamming_edges(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join all within ``radius`` bits of each other, at any remove.

    ``prints`` has distinct longs in ``fp``. Not every pair within the radius is a row: each block of
    compared fingerprints gives a spanning forest of its links, at most one row a fingerprint.
    """
    n, both = bit_statistics(prints)
    if n < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    # Wider parts (fewer of them) pay once buckets of narrow ones would hold many fingerprints.
    parts = radius + 1 if n < 1 << 23 else max(2, radius)
    groups = group_bits(n, both, parts)
    exact = probe_keys(prints, groups, [0] * parts)
    sums = {r["part"]: r["pairs"] for r in exact.groupBy("part", "key").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    p = np.diag(both) / n
    costs = []
    for i, bits in enumerate(groups):
        at = np.zeros(len(bits) + 1)
        at[0] = 1.0
        for q in 2 * p[bits] * (1 - p[bits]):
            at[1:] = at[1:] * (1 - q) + at[:-1] * q
            at[0] *= 1 - q
        within = np.cumsum(at)
        keys = np.cumsum([1.0, *(np.prod([len(bits) - k for k in range(t)]) / np.prod(np.arange(1, t + 1)) for t in range(1, radius + 1))])
        # compared pairs (measured for equal keys, scaled to larger thresholds) and the rows sent, worth some comparisons each
        costs.append([0.0] + [sums.get(i, 0.0) * within[min(t, len(bits))] / max(within[0], 1e-300) * (1 if t == 0 else keys[t]) + 50.0 * n * keys[t] for t in range(radius + 1)])
    thresholds = allocate_thresholds(costs, radius)
    keyed = dealt_blocks(probe_keys(prints, groups, thresholds), ["part", "key"], F.col("fp"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in group_batches(batches):
            g, f = x["__g"].to_numpy("i8"), x["fp"].to_numpy("i8")
            at, lag, ends = np.arange(len(g)), 0, [(np.zeros(0, int), np.zeros(0, int))]
            while len(at):
                lag += 1
                at = at[at + lag < len(g)]
                at = at[g[at] == g[at + lag]]
                hit = at[np.bitwise_count(np.bitwise_xor(f[at], f[at + lag]).view(np.uint64)) <= radius]
                hit = hit[f[hit] != f[hit + lag]]
                ends.append((hit, hit + lag))
                if len(ends) > 64:  # a forest says as much in less memory
                    ends = [_forest(len(g), ends)]
            a, root = _forest(len(g), ends)
            if len(a):
                yield pd.DataFrame({"a": f[a], "b": f[root]})

    def _forest(n: int, ends: list) -> tuple[np.ndarray, np.ndarray]:
        label = local_components(n, np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
        moved = np.flatnonzero(label != np.arange(n))
        return moved, label[moved]

    return spread(keyed.select("__g", "fp"), "__g").sortWithinPartitions("__g").mapInPandas(compare, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """``id_col``, ``fp`` (long) and ``component_id`` for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; a component's id is the smallest id that is
    reachable over links. Search: bits that correlate are grouped into partitions; dynamic programming
    over measured and estimated candidate counts allots each partition its own threshold under the
    general pigeonhole principle; fingerprints within a partition's threshold are compared in full.
    Equal fingerprints are one node throughout, so copies cost nothing. Empty and null texts have
    fingerprint zero and link like any other; rows with null ids are kept and never name a component
    (its id is null if it has no other); repeated rows are kept; an empty table gives an empty one.
    """
    rows, named = _components(docs, id_col, text_col, shingle_words, radius)
    return rows.join(named, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(``__id``, ``__k``, a hash of id and text, ``fp`` of each row; ``fp``, ``component_id`` and ``label``, one of each component's own, of each fingerprint)."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = materialise(fingerprints(rows.withColumn("__k", F.xxhash64("__id", "__text")), "__text", shingle_words).select("__id", "__k", "fp"), "simhash-fp")
    classes = materialise(rows.groupBy("fp").agg(F.min("__id").alias("__least")), "simhash-classes")
    linked = connected_components(hamming_edges(classes.select("fp"), radius))
    label = F.when(F.col("component").isNull(), F.xxhash64("fp", F.lit("alone"))).otherwise(F.xxhash64("component", F.lit("linked")))
    named = materialise(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "__least", label.alias("label")), "simhash-named")
    least = materialise(named.groupBy("label").agg(F.min("__least").alias("component_id")), "simhash-least")
    return rows, materialise(named.join(least, "label").select("fp", "component_id", "label"), "simhash-components")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, of the least id and then the least hash of id and text.

    Ids may repeat: a text is never lost because another has its id. Of a component whose ids are all null all rows stay.
    """
    from loomwork.llm.near_texts import keep_one_of_each

    rows, named = _components(docs, id_col, text_col, shingle_words, radius)
    return keep_one_of_each(docs, id_col, text_col, rows.join(named, "fp"))
