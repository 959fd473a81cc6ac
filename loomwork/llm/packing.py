"""Packing of tokenised documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import materialise

#: Pieces that one task packs together: enough to waste under a thousandth, few enough for one task.
GROUP_PIECES = 4096
#: Words whose token ids a task remembers.
MEMO_WORDS = 400_000


# Fixed value: the word pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(tok) -> Callable[[str], list[int]] | None:
    """A faster encoder for short texts with the same ids, if the tokenizer is a byte-level BPE whose ids are its merge ranks."""
    import json

    import tiktoken

    spec = json.loads(tok.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("words", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def fast_encoder(tokenizer_path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    A byte-level BPE with the usual word pattern never joins tokens over a single space that stands
    between other characters: the space opens the next word. So a text is cut at single spaces and the
    ids of each word are remembered. Texts where that doesn't hold (runs of white space with a space at
    their end, or the tokenizer's special tokens) go to the tokenizer whole.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    short = rank_encoder(tok)
    memo: dict[str, bytes] = {}
    unsafe: set[str] = {""}

    def raw(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(words: list[str]) -> list[bytes]:
        return [np.array(short(w), "<u4").tobytes() for w in words] if short else raw(words)

    def encode(texts: list[str]) -> list[bytes]:
        if len(memo) > MEMO_WORDS:
            memo.clear()
            unsafe.clear()
            unsafe.add("")
        cut = [t.split(" ") for t in texts]
        new = list(set().union(*[c[1:] for c in cut]).difference(memo))
        for w, ids in zip(new, of_words([f" {w}" for w in new]), strict=True):
            memo[w] = ids
            if not w or w[-1].isspace() or not w[-1].isprintable():
                unsafe.add(w)
        heads = of_words([c[0] for c in cut])
        out: list[bytes] = []
        for t, c, head in zip(texts, cut, heads, strict=True):
            h = c[0]
            if (len(c) > 1 and ((h and (h[-1].isspace() or not h[-1].isprintable())) or not unsafe.isdisjoint(c[1:-1]) or not c[-1])) or any(s in t for s in special):
                out += raw([t])
            else:
                out.append(head + b"".join([memo[w] for w in c[1:]]))
        return out

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut only where longer than ``capacity``.

    All pieces of a cut document but the first have full length.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        encode = fast_encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, len(b), 256):
                x = b.iloc[at : at + 256]
                rows = []
                for i, ids in zip(x["id"], encode([t if isinstance(t, str) else "" for t in x["text"]]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        rows.append((None if pd.isna(i) else i, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])))
                out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
                if kind in ("bigint", "int", "smallint", "tinyint"):
                    out["id"] = out["id"].astype("Int64")
                yield out

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def place_longest_first(lengths: np.ndarray, capacity: int, tightest: bool = False) -> tuple[np.ndarray, int]:
    """(bin of each length, number of bins), placed longest first.

    Among the open bins that a piece fits, it goes to one whose residual gap makes the sum over gaps
    of the squared number of open bins least (ties: the tightest gap), or with ``tightest`` always to the tightest gap; a
    bin that it fills is open no more. Where it fits none, a bin is opened.
    """
    where = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    bins = int((lengths == capacity).sum())
    where[order[:bins]] = np.arange(bins)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; at 0 always none
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    far = np.int64(1) << 40
    for i in order[bins:].tolist():
        x = int(lengths[i])
        have = count[x:capacity]
        if tightest:
            j = int((have > 0).argmax())
        else:
            change = np.where(have > 0, 2 * (count[: capacity - x] - have), far)
            change[0] -= 1  # closing a bin leaves no new gap to count
            j = int(change.argmin())
        if have[j]:
            gap = x + j
            b = stacks[gap].pop()
            count[gap] -= 1
            if j:
                count[j] += 1
                stacks[j].append(b)
            where[i] = b
        else:
            where[i] = bins
            count[capacity - x] += 1
            stacks[capacity - x].append(bins)
            bins += 1
    return where, bins


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) for each length, and the number of bins, by the sum-of-squares rule, longest first.

    Weighing a new bin against the open ones by the same rule needs 4 % more bins on lengths spread evenly
    up to ``capacity``, so one is opened only where a piece fits none. Where the rule needs more bins than
    total / capacity, the same is tried with the tightest gaps, and the fewer bins count: never more than best fit.
    """
    where, bins = place_longest_first(lengths, capacity)
    if bins * capacity >= lengths.sum() + capacity:
        other, fewer = place_longest_first(lengths, capacity, tightest=True)
        if fewer < bins:
            where, bins = other, fewer
    order = np.lexsort((-lengths, where))
    before = np.cumsum(lengths[order]) - lengths[order]
    offset = np.zeros(len(lengths), np.int64)
    offset[order] = before - before[np.searchsorted(where[order], where[order])] if len(lengths) else before
    return where, offset, bins


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    The tokenizer's file must be readable at ``tokenizer_path`` on every executor. Pieces are numbered
    as they are written and dealt at random, by a hash of that number, to groups of about 4096, also where rows are
    equal; each group is packed by the sum-of-squares rule, longest first. Every sequence is within one group,
    so no task grows with the table. Against the lower bound total / capacity, a group wastes about one
    sequence in a thousand (five where lengths are spread evenly up to ``capacity``; there no packing
    reaches that bound).

    Null and empty texts are one piece that holds only ``end_id``. Repeated rows are packed as often as
    they occur. Null ids are kept. An empty table gives an empty one. Other columns of ``docs`` aren't read.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    pieces = materialise(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("__g", F.pmod(F.xxhash64("__row"), F.lit(groups))).drop("__row")

    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
        x["sequence_id"], x["offset"], _ = sum_of_squares(x["length"].to_numpy(), capacity)
        x["sequence_id"] += int(key[0]) << 32
        return x.drop(columns="__g")

    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.groupBy("__g").applyInPandas(pack, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
