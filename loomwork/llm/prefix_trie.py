"""Prefix trie of conversations by an LCP-aware external mergesort.

Sorted runs carry with each sequence the number of leading turns it shares with the one before (its LCP). The runs are
written tables, one run for each task that sorted; ranges of the order are merged side by side, each by a tournament of
losers that compares turns only past what two heads are known to share. The merged stream keeps a stack of the nodes on
the open path and gives out a node once the stream has left it. Nodes that may go on in another range are given out in
parts, which are added up afterwards: at most two paths a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import join_small, materialise, word_count

#: Bytes of a turn's digest.
TURN = 16
#: Bytes of sequences that a task merges, about: what it holds in memory.
RANGE_BYTES = 8 << 20
#: Ids that are joined into one piece before they are hashed in order.
PIECE_IDS = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "depth int, least long, n long, children long, leaves long, saved long, ends_n long, ends_least long, seq_key string, parent_least long, key string, parent_key string, words long, slot_first long, slot_last long"


def turn_sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: ``conv_id`` (long), ``seq`` (16 bytes a turn, in order) and ``words`` (an int a turn).

    Turns are ordered by ``turn_col``, nulls first, equal ones by their digest; null roles and texts are empty; rows
    without a conversation's id take no part. Only digests and counts are shuffled, never texts; a task's turns of a
    conversation are gathered before they are, and one conversation's digests (16 bytes a turn) must fit in a task.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).isNotNull().alias("o"), F.col(turn_col).alias("t"), digest.alias("d"), word_count(text).cast("int").alias("w")).alias("x"))
    lists = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("x", lambda t: t["d"]), "")).alias("seq"), F.transform("x", lambda t: t["w"]).alias("words"))


def with_shared_openings(seqs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % ``every``; h is crc32(c) % (``most`` + 1).

    All of that conversation's turns if it has fewer, none if there is no such conversation. ``seqs`` should be a written table: it is read twice.
    """
    openings = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__b"), F.expr(f"substring(seq, 1, {TURN * most})").alias("__s"), F.slice("words", 1, most).alias("__w"))
    out = seqs.withColumn("__h", (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")).withColumn("__b", F.col("conv_id") - F.col("conv_id") % every).join(openings, "__b", "left")
    head = F.coalesce(F.expr(f"substring(__s, 1, {TURN} * __h)"), F.lit(b""))
    words = F.concat(F.coalesce(F.expr("slice(__w, 1, __h)"), F.array().cast("array<int>")), F.expr("slice(words, __h + 1, greatest(size(words), 1))"))
    return out.select("conv_id", F.concat(head, F.expr(f"substring(seq, {TURN} * __h + 1)")).alias("seq"), words.alias("words"))


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """Leading turns that two sequences share, known to be ``at`` or more."""
    most = min(len(a), len(b)) // TURN
    while at < most and a[TURN * at : TURN * (at + 1)] == b[TURN * at : TURN * (at + 1)]:
        at += 1
    return at


def sorted_runs(distinct: DataFrame) -> DataFrame:
    """``distinct`` (seq, n, least, words) sorted within each task, with ``run``, ``at`` (the place in the run) and ``lcp``."""

    def lcps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, at, before = TaskContext.get().partitionId(), 0, b""
        for b in batches:
            out = []
            for s in b["seq"]:
                out.append(shared_turns(before, s))
                before = s
            b["run"], b["at"], b["lcp"] = run, range(at, at + len(b)), out
            at += len(b)
            yield b

    return distinct.select("seq", "n", "least", "words").sortWithinPartitions("seq").mapInPandas(lcps, "seq binary, n long, least long, words array<int>, run int, at long, lcp int")


class LoserTree:
    """Merges sorted runs that carry LCPs; iterating gives (run, place, LCP with the row before)."""

    def __init__(self, runs: list[list[bytes]], lcps: list[list[int]]):
        self.runs, self.lcps, self.k = runs, lcps, len(runs)
        self.place, self.shared = [0] * self.k, [0] * self.k
        self.losers = [0] * max(self.k, 1)
        self.compared = 0

    def play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads. Both LCPs are held against the row that came out last: the head that shares more with it is less."""
        if self.place[y] >= len(self.runs[y]):
            return x, y
        if self.place[x] >= len(self.runs[x]):
            return y, x
        shared = self.shared
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        a, b = self.runs[x][self.place[x]], self.runs[y][self.place[y]]
        at = shared_turns(a, b, shared[x])
        self.compared += at - shared[x] + 1
        w, l = (x, y) if a[TURN * at : TURN * (at + 1)] <= b[TURN * at : TURN * (at + 1)] else (y, x)
        shared[l] = at
        return w, l

    def _first(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        w, self.losers[node] = self.play(self._first(2 * node), self._first(2 * node + 1))
        return w

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        if not self.k:
            return
        w = self._first(1)
        while self.place[w] < len(self.runs[w]):
            yield w, self.place[w], self.shared[w]
            self.place[w] += 1
            if self.place[w] < len(self.runs[w]):
                self.shared[w] = self.lcps[w][self.place[w]]
            node = (w + self.k) // 2
            while node:
                w, self.losers[node] = self.play(w, self.losers[node])
                node //= 2


class OpenPath:
    """The nodes from the root to the sequence that came last; nodes are given out as the stream leaves them."""

    __slots__ = ("rows", "stack", "slot")

    def __init__(self, slot: int):
        self.slot, self.stack, self.rows = slot, [], []

    # an open node: [members, least, finished children, leaves, saved, words, ends, least end, on the first path, key, rows of its children]
    def take(self, seq: bytes, shared: int, n: int, least: int, words) -> None:
        first = not self.stack
        while len(self.stack) - 1 > shared:
            self.close(False)
        if first:
            self.stack.append([0, least, 0, 0, 0, 0, 0, None, True, None, []])
        for d in range(len(self.stack) - 1, len(seq) // TURN):
            self.stack.append([0, least, 0, 0, 0, int(words[d]), 0, None, first, None, []])
        if first:
            self.name(seq)
        top = self.stack[-1]
        top[0] += n
        top[1] = min(top[1], least)
        top[6] += n
        top[7] = least if top[7] is None else min(top[7], least)
        if top[6] > 1 and top[9] is None:
            top[9] = hashlib.md5(seq).hexdigest()

    def name(self, seq: bytes) -> None:
        """Give the nodes on this path the digests of their sequences: other ranges may have the same nodes."""
        h = hashlib.md5()
        for d, node in enumerate(self.stack):
            h.update(seq[TURN * (d - 1) : TURN * d] if d else b"")
            node[9] = node[9] or h.copy().hexdigest()

    def close(self, last: bool) -> None:
        n, least, children, leaves, saved, words, ends, end, first, key, kids = self.stack.pop()
        depth, up = len(self.stack), self.stack[-1] if self.stack else None
        part = first or last
        if not part:
            leaves += not children
            saved += (n - 1) * words
        if up:
            up[0] += n
            up[1] = min(up[1], least)
            up[2] += not part
            up[3] += leaves
            up[4] += saved
            if not part:
                up[10].append(len(self.rows))
        for k in kids:
            if part:
                self.rows[k][11] = key
            else:
                self.rows[k][9] = least
        slots = (self.slot + (not first), self.slot + last) if part else (None, None)
        self.rows.append([depth, least, n, children, leaves, saved, ends, end, key if ends > 1 else None, None, key if part else None, up[9] if part and up else None, words, *slots])

    def finish(self, seq: bytes) -> list[list]:
        self.name(seq)
        while self.stack:
            self.close(True)
        return self.rows


def trie_parts(runs: DataFrame, ranges: int) -> DataFrame:
    """Merge ``runs`` in ``ranges`` ranges of the order: a row per finished node, and a row per range for nodes on its outer paths (``key`` isn't null)."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seqs: dict[int, list] = {}
        for b in batches:
            for run, *row in zip(b["run"], b["seq"], b["lcp"], b["n"], b["least"], b["words"], strict=True):
                seqs.setdefault(run, []).append(row)
        if not seqs:
            return
        rows = list(seqs.values())
        path, seq = OpenPath(2 * TaskContext.get().partitionId()), b""
        for r, i, shared in LoserTree([[x[0] for x in run] for run in rows], [[x[1] for x in run] for run in rows]):
            seq, _, n, least, words = rows[r][i]
            path.take(seq, shared, int(n), int(least), words)
        out = path.finish(seq)
        names = [c.split()[0] for c in _NODE.split(", ")]
        for at in range(0, len(out), 50_000):
            x = pd.DataFrame(out[at : at + 50_000], columns=names)
            for c in ("ends_least", "parent_least", "slot_first", "slot_last"):
                x[c] = x[c].astype("Int64")
            yield x

    return runs.repartitionByRange(ranges, "seq").sortWithinPartitions("run", "at").mapInPandas(merge, _NODE)


def joined_ends(ends: DataFrame, ranges: int) -> DataFrame:
    """(seq_key, ends_sha256) of ``ends`` (seq_key, conv_id): the ids of a key in order, comma-joined, hashed.

    Ranges of (key, id) join their ids into pieces of up to 8,192 first, so that a hot key's rows are dealt to many tasks; the
    hash of a key, which can only be taken in order, then runs over few rows, in bounded memory.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, out = None, [], []

        def cut() -> None:
            if ids:
                out.append((key, ids[0], ",".join(map(str, ids))))

        for b in batches:
            for k, c in zip(b["seq_key"], b["conv_id"], strict=True):
                if k != key or len(ids) >= PIECE_IDS:
                    cut()
                    key, ids = k, []
                ids.append(c)
            yield pd.DataFrame(out, columns=["seq_key", "first", "piece"])
            out = []
        cut()
        yield pd.DataFrame(out, columns=["seq_key", "first", "piece"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h, out = None, None, []
        for b in batches:
            for k, p in zip(b["seq_key"], b["piece"], strict=True):
                if k == key:
                    h.update(b"," + p.encode())
                else:
                    if h:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(p.encode())
            yield pd.DataFrame(out, columns=["seq_key", "ends_sha256"])
            out = []
        yield pd.DataFrame([(key, h.hexdigest())] if h else [], columns=["seq_key", "ends_sha256"])

    joined = ends.repartitionByRange(ranges, "seq_key", "conv_id").sortWithinPartitions("seq_key", "conv_id").mapInPandas(pieces, "seq_key string, first long, piece string")
    return joined.repartition(ranges, "seq_key").sortWithinPartitions("seq_key", "first").mapInPandas(digest, "seq_key string, ends_sha256 string")


def _added_up(parts: DataFrame) -> DataFrame:
    """The nodes that ranges gave out in parts, each once, with all of their subtree.

    A slot is the first or last path of a range. In the order of the tree a node starts at its first slot, and every node that starts
    in a later one of its slots lies below it: totals by slot and their running sum (a row or two a range) give what lies below.
    """
    whole = parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved", "ends_n")],
                                     F.min("ends_least").alias("ends_least"), F.max("words").alias("words"), F.min("slot_first").alias("a"), F.max("slot_last").alias("z"))
    whole = materialise(whole, "trie-open")
    kids = whole.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    own = whole.join(kids, "key", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    own = own.withColumn("leaf", (F.col("children") == 0).cast("long")).withColumn("own", (F.col("n") - 1) * F.col("words"))
    deeper = Window.partitionBy("a").orderBy(F.desc("depth"))
    own = materialise(own.withColumn("leaf_in", F.sum("leaf").over(deeper)).withColumn("own_in", F.sum("own").over(deeper)), "trie-own")
    both = own.select(F.col("a").alias("slot"), "leaf", "own").union(own.select("z", F.lit(0), F.lit(0))).groupBy("slot").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    sums = materialise(both.select("slot", F.sum("leaf").over(upto).alias("leaf_a"), F.sum("own").over(upto).alias("own_a")), "trie-slots")
    ends = sums.withColumnsRenamed({"slot": "z", "leaf_a": "leaf_z", "own_a": "own_z"})
    out = own.join(sums.withColumnRenamed("slot", "a"), "a").join(ends, "z")
    out = out.withColumn("leaves", F.col("leaves") + F.col("leaf_in") + F.col("leaf_z") - F.col("leaf_a")).withColumn("saved", F.col("saved") + F.col("own_in") + F.col("own_z") - F.col("own_a"))
    up = whole.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_least"))
    return out.join(up, "parent_key", "left").withColumn("seq_key", F.when(F.col("ends_n") > 1, F.col("key")))


def conversation_trie(seqs: DataFrame) -> DataFrame:
    """The trie of all prefixes of the conversations in ``seqs`` (``conv_id``, ``seq``, ``words``; see ``turn_sequences``): a row per node.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256`` (of the ids of conversations that end here). Equal
    sequences are counted before they are sorted, so copies cost nothing; conversations without turns end at
    the root; repeated ids are members as often as they are rows; no conversations give no nodes.
    """
    seqs = materialise(seqs, "trie-seqs")
    distinct = seqs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.min("words").alias("words"))
    runs = materialise(sorted_runs(distinct), "trie-runs")
    total = runs.agg(F.sum(F.length("seq"))).first()[0] or 0
    ranges = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    nodes = materialise(trie_parts(runs, ranges), "trie-nodes")
    opened = materialise(_added_up(nodes.where("key is not null")), "trie-whole")
    kept = ["depth", "least", "n", "children", "leaves", "saved", "ends_n", "ends_least", "seq_key", "parent_least"]
    inner = nodes.where("key is null")
    below = join_small(inner.where("parent_key is not null").drop("parent_least"), opened.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_least")), ["parent_key"], salt=F.xxhash64("least", "depth"))
    rows = inner.where("parent_key is null").select(kept).union(below.select(kept)).union(opened.select(kept))
    several = materialise(runs.where("n > 1").select(F.md5("seq").alias("seq_key")), "trie-several")
    ends = join_small(seqs.select(F.md5("seq").alias("seq_key"), "conv_id"), several, ["seq_key"], salt=F.col("conv_id"))
    hashed = joined_ends(ends, ranges)
    one = rows.where("ends_n <= 1").withColumn("ends_sha256", F.when(F.col("ends_n") == 0, F.lit(NO_ENDS)).otherwise(F.sha2(F.col("ends_least").cast("string"), 256)))
    many = rows.where("ends_n > 1").join(hashed, "seq_key")
    out = [F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"]
    return one.select(out).union(many.select(out))
