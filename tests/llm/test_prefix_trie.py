"""The conversation trie against a plain version, and its merge by itself."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.llm.common import materialise
from loomwork.llm.prefix_trie import LoserTree, conversation_trie, shared_turns, turn_sequences, with_shared_openings

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 if rebuild else 0 for c in own}
    convs = {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += cost
    ends = {p: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def built(spark, rows, rebuild=True, parts=5):
    own = materialise(turn_sequences(spark.createDataFrame(rows, SCHEMA).repartition(parts)), "t")
    out = conversation_trie(with_shared_openings(own) if rebuild else own)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: tuple(-1 if x is None else x for x in r))


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain(spark, seed, rebuild):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "", "d e  f\n"])) for c in r.sample(range(200), 120) for t in range(r.randint(1, 7))]
    rows += [(c, t, "user", f"long {t}") for c in (900, 901, 903) for t in range(60)]
    assert built(spark, rows, rebuild) == plain(rows, rebuild)


def test_trie_odd_rows(spark):
    rows = [
        (1, None, "user", None), (1, 0, None, "x y"), (1, -3, "user", "first"),  # null turn first, null role and text empty
        (2, 0, "us", "erx"), (3, 0, "user", "x"),  # not the same turn
        (None, 0, "user", "lost"), (5, 0, "user", "é　ü"), (6, 1, "user", "é　ü"), (7, 9, "user", "w " * 200_000),
        (9, 4, "user", "only turns that are replaced"),
    ]
    for rebuild in (True, False):
        assert built(spark, rows, rebuild) == plain(rows, rebuild)


def test_trie_of_nothing(spark):
    assert built(spark, [], True) == []


def test_trie_copies_and_hot_opening(spark):
    """A third of the conversations equal, nearly all with one first turn: equal ones are counted before the sort, ids are hashed from pieces."""
    rows = [(c, t, "user", f"{'same' if t == 0 else 'copy' if c % 3 == 0 else c} {t}") for c in range(900) for t in range(3)]
    assert built(spark, rows, False, parts=7) == plain(rows, False)


def test_trie_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 5, 7)], SCHEMA + ", seq int, words int")
    out = conversation_trie(turn_sequences(df.withColumn("turn", F.col("turn").cast("double")))).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in out) == [(1, 0, 1), (1, 1, 1)]


def test_loser_tree_skips_shared_turns():
    r = random.Random(3)
    turn = lambda x: hashlib.md5(str(x).encode()).digest()
    seqs = sorted({b"".join([turn(k) for k in range(100)] + [turn(r.random()) for _ in range(r.randint(0, 4))]) for _ in range(300)} | {b"".join(turn(r.randint(0, 2)) for _ in range(r.randint(0, 5))) for _ in range(100)})
    for k in (1, 2, 3, 7, 16):
        runs = [[] for _ in range(k)]
        for s in seqs:
            runs[r.randrange(k)].append(s)
        lcps = [[shared_turns(run[i - 1], s) if i else 0 for i, s in enumerate(run)] for run in runs]
        tree = LoserTree(runs, lcps)
        out = [(runs[a][i], shared) for a, i, shared in tree]
        assert [s for s, _ in out] == seqs
        assert [n for _, n in out[1:]] == [shared_turns(a, b) for a, b in zip(seqs, seqs[1:])]
        assert tree.compared < 6 * len(seqs) * max(1, k.bit_length()) + 101 * k  # from the first turn on it would be over 100 each
