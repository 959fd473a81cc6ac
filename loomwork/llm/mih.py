"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import materialise, spread
from loomwork.llm.simhash import group_batches
from loomwork.llm.vectors import common_dimension, deal_pairs, matrix, sample_matrix, usable

#: Vectors that the rotation and the radius are fitted on at most; every vector is indexed.
SAMPLE = 20_000
BITS = 64
#: Substrings of a code, two bytes each; each has an index table of its own.
PARTS = 4
WIDTH = BITS // PARTS
#: Share of the sample's true neighbours that the radius is to cover.
COVER = 0.985
HOME_BLOCK, QUERY_BLOCK = 4096, 1024


class RotatedCodes:
    """64-bit codes: centred vectors on their principal axes, turned so that signs lose least (iterative quantisation)."""

    def __init__(self, sample: np.ndarray, rounds: int = 20, seed: int = 0):
        self.mean = sample.mean(0)
        x = sample - self.mean
        _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)))
        axes = axes[:, ::-1][:, :BITS]
        self.axes = np.hstack([axes, np.zeros((axes.shape[0], BITS - axes.shape[1]))])
        rng = np.random.default_rng(seed)
        turn, _ = np.linalg.qr(rng.standard_normal((BITS, BITS)))
        flat = x @ self.axes
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ vt).T
        self.axes = self.axes @ turn

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of eight bytes."""
        return np.packbits((x - self.mean) @ self.axes >= 0, axis=1)


def fit_radius(codes: RotatedCodes, sample: np.ndarray, k: int, cover: float = COVER, queries: int = 256) -> int:
    """The Hamming radius that holds ``cover`` of the k nearest neighbours, measured by brute force within the sample.

    Neighbours in all the data are nearer than those in a sample of it, so the radius errs on the large side.
    """
    q = sample[:: max(1, len(sample) // queries)][:queries]
    d = (q * q).sum(1)[:, None] + (sample * sample).sum(1)[None] - 2 * q @ sample.T
    d[np.arange(len(q)), np.arange(0, len(sample), max(1, len(sample) // queries))[: len(q)]] = np.inf
    near = np.argpartition(d, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(q), 1), int)
    c = codes.encode(sample)
    apart = np.bitwise_count(codes.encode(q)[:, None, :] ^ c[near]).sum(2)
    return int(np.quantile(apart, cover, method="higher"))


def part_radii(radius: int, parts: int = PARTS) -> list[int]:
    """Radii for the substrings such that codes within ``radius`` agree with one of them: sum of (r + 1) is radius + 1."""
    if radius >= BITS:  # everything: one part finds it all
        return [WIDTH] + [-1] * (parts - 1)
    a, rest = divmod(radius, parts)
    return [a if i <= rest else a - 1 for i in range(parts)]


def _search(queries: DataFrame, rows: DataFrame, codes: RotatedCodes, radius: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each query at least the k nearest of the rows whose codes lie within ``radius``."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)
    radii = part_radii(radius)
    vec = rows.schema["vec"].dataType.simpleString()
    n = rows.count()
    # A key is a run of a substring's values, those with the same leading bits: together they hold about a block of rows.
    lead = min(WIDTH, max(0, int(np.ceil(np.log2(max(1, n / HOME_BLOCK))))))
    runs = np.arange(1 << lead, dtype=np.uint16)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                y = b.iloc[at : at + 1024]
                if not len(y):
                    continue
                c = shared.value.encode(matrix(y["vec"]))
                raw, own = [r.tobytes() for r in c], c.view("<u2") >> (WIDTH - lead)
                home = bool(y["home"].iat[0])
                for p in range(PARTS):
                    if radii[p] < 0:
                        continue
                    if home:
                        yield y.assign(code=raw, part=p, run=own[:, p].astype(np.int32))
                    else:  # a run holds a value within the radius only if its leading bits are
                        i, run = np.nonzero(np.bitwise_count(own[:, p, None] ^ runs[None]) <= radii[p])
                        z = y.iloc[i].assign(part=p, run=run)
                        z["code"] = [raw[a] for a in i]
                        yield z

    schema = f"id long, vec {vec}, home boolean, code binary, part int, run int"
    cols = [x.split()[0] for x in schema.split(", ")]

    def ordered(batches):
        for b in index(batches):
            yield b[cols]

    parts = [x.select("id", "vec", F.lit(h).alias("home")).mapInPandas(ordered, schema) for x, h in ((rows, True), (queries, False))]
    keyed = materialise(parts[0].union(parts[1]), "mih-index")
    dealt = deal_pairs(keyed, ["part", "run"], "id", HOME_BLOCK, QUERY_BLOCK).select("__g", "id", "vec", "home", "code", "part")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in group_batches(batches, 2048):
            for _, g in batch.groupby("__g", sort=False):
                at_home = g["home"].to_numpy(bool)
                home, ask, p = g[at_home], g[~at_home], int(g["part"].iat[0])
                if not len(home) or not len(ask):
                    continue
                x, every = matrix(home["vec"]), matrix(ask["vec"])
                xid, ids = home["id"].to_numpy("i8"), ask["id"].to_numpy("i8")
                xw, words = (np.frombuffer(b"".join(s["code"]), "<u8") for s in (home, ask))
                x2 = (x * x).sum(1)
                for first in range(0, len(ask), 256):
                    q, qid, qw = (v[first : first + 256] for v in (every, ids, words))
                    q2 = (q * q).sum(1)
                    differ = qw[:, None] ^ xw[None]
                    hit = (np.bitwise_count(differ) <= radius) & (qid[:, None] != xid[None])
                    for part in range(p + 1):  # within this part's radius, and a pair counts in the first part that finds it
                        apart = np.bitwise_count((differ >> np.uint64(WIDTH * part)).astype(np.uint16))
                        hit &= apart <= radii[part] if part == p else apart.astype(np.int16) > radii[part]
                    far = np.where(hit, q2[:, None] + x2[None] - 2 * q @ x.T, np.inf)
                    kth = np.partition(far, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
                    slack = 1e-11 * (q2 + x2.max())
                    i, j = np.nonzero((far <= (kth + slack)[:, None]) & np.isfinite(far))
                    d = np.empty(len(i))
                    for at in range(0, len(i), 1 << 15):
                        s = slice(at, at + (1 << 15))
                        d[s] = np.sqrt(((q[i[s]] - x[j[s]]) ** 2).sum(1))
                    order = np.lexsort((xid[j], d, i))
                    i, j, d = i[order], j[order], d[order]
                    top = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield pd.DataFrame({"query_id": qid[i[top]], "vec_id": xid[j[top]], "score": d[top]})

    return spread(dealt, "__g").sortWithinPartitions("__g").mapInPandas(probe, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by Euclidean distance that the index finds for each query row.

    Codes are cut into four substrings, each indexed by its value. A query looks into every bucket
    within the substring's radius; by the pigeonhole principle that finds every code within the full
    radius, and no other passes. What passes is ranked by the distance of the original vectors in
    double precision. The radius is fitted to cover 98.5 % of true neighbours. A query that finds fewer
    than k is searched again with a radius of all bits, which is exact.

    A query's own id is no candidate. Vectors that are null, empty, zero, hold null or non-finite
    components, have another length than most, or a null id take no part. Ties go to the smaller id.
    Rows that repeat an id are candidates each; a repeated query is asked once. Too few candidates give
    all of them; no vectors give an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), "__q")
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    d = common_dimension(rows)
    rows = rows.where(F.size("vec") == d)
    x = sample_matrix(rows, sample)
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(x):
        return spark.createDataFrame([], schema)
    codes = RotatedCodes(x)
    queries = materialise(rows.where("__q").select("id", "vec").dropDuplicates(["id"]), "mih-queries")
    base = rows.select("id", "vec")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = materialise(ranked(_search(queries, base, codes, fit_radius(codes, x, k), k)), "mih-found")
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = materialise(queries.join(full, "id", "left_anti"), "mih-short")
    if not short.isEmpty():
        again = ranked(_search(short, base, codes, BITS, k))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(materialise(again, "mih-again"))
    return found.select("query_id", "rank", "vec_id", "score")
