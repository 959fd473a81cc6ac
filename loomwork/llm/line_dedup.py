"""Line deduplication: winnowed fingerprints of line hashes find repeated runs, later ones are deleted."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, materialise

#: What ends a line. A sentence end before a blank does too, so that passages inside a paragraph are found.
LINE_ENDS = ("\n", ". ", "! ", "? ")
_MARK = "\x01"


def text_lines(text: Column, line_ends: Sequence[str] = LINE_ENDS) -> Column:
    """The lines of a text with their ends, in order; joined they are the text."""
    marked = text
    for e in line_ends:
        marked = F.replace(marked, F.lit(e), F.lit(e + _MARK))
    behind = "|".join(f"(?<={re.escape(e)})" for e in line_ends)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, behind)).otherwise(F.split(marked, _MARK))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, line_ends: Sequence[str] = LINE_ENDS) -> DataFrame:
    """Rows (__id, __th, __from, __to): the lines of each document, from 0, that belong to later copies of runs.

    A run is consecutive lines (those without words are skipped); a repeat is a run of ``min_words`` words or more
    that occurred earlier (smaller id, then hash of the text, then position; not overlapping it). All lines of
    all repeats go, so runs are deleted to both their ends.

    Winnowing: a window is the shortest run from a line on, or up to a line, with ``min_words`` words or more, and its
    fingerprint is the least of its lines' hashes, at that line's place. Two equal windows choose the same one, so
    a repeat can't be missed. Lines whose hash occurs once are in no repeat; windows don't reach over them,
    and fingerprints found at one place only are dropped. Around the others, matches are extended both ways: each line of a repeat is
    in the window that starts at it or in the one that ends at it or later. Places with equal
    fingerprints are joined by the windows' contents, not in pairs: the first place of a content stands for all, so
    a passage in a third of all documents costs a row for each. Contents and lines are compared by 64-bit
    XXH64 of their words and white space inside; that two different ones agree is left to chance (1 in 2**64 a pair).

    Windows of one document are found in one task; a document is one row of the input anyway.
    """
    d = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__t")).where(F.col("__t").isNotNull())
    lines = d.select("__id", "__th", F.posexplode(text_lines(F.col("__t"), line_ends)).alias("__pos", "__line"))
    lines = lines.select("__id", "__th", "__pos", "__line", F.btrim("__line", F.lit(" \n\r\t")).alias("__core"))
    # most lines have single blanks only: their words are blanks and one, and their hash needs no change of characters
    core = F.col("__core")
    odd = core == ""
    for c in ("  ", "\t", "\r", "\x0b", "\x0c", "\n"):
        odd = odd | F.contains(core, F.lit(c))
    words = F.when(odd, F.regexp_count("__line", F.lit(WORD))).otherwise(F.octet_length(core) - F.octet_length(F.replace(core, F.lit(" "), F.lit(""))) + 1)
    key = F.when(odd, F.xxhash64(F.trim(F.translate("__line", "\n\r\t", "   ")))).otherwise(F.xxhash64(core))
    lines = lines.select("__id", "__th", "__pos", words.alias("__w"), key.alias("__k"))
    lines = lines.select("__id", "__th", "__pos", "__w", F.when(F.col("__w") > 0, F.col("__k")).otherwise(F.lit(0)).alias("__h"))
    lines = materialise(lines, "lines-all")
    # written first: a join of two plain tables can split the rows of a very common line over tasks
    again = materialise(lines.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or __h = 0").select("__h"), "lines-again")
    kept = lines.join(again.hint("shuffle_hash"), "__h", "left_semi")
    doc = Window.partitionBy("__id", "__th")
    by_pos = doc.orderBy("__pos")
    # equal rows (same id and text) are one document: of a line's copies the first counts
    kept = kept.withColumn("__prior", F.lag("__pos").over(by_pos))
    fresh = F.col("__prior").isNull() | (F.col("__prior") < F.col("__pos"))
    gap = F.when(F.col("__prior").isNull() | (F.col("__pos") - F.col("__prior") > 1), min_words).otherwise(0)
    # words up to each line's end, with a jump wherever lines are missing that is too long for a window
    upto = F.sum(F.when(fresh, F.col("__w") + gap).otherwise(0)).over(by_pos.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("__e", upto).where(fresh & (F.col("__w") > 0)).withColumn("__c", F.col("__e") - F.col("__w"))
    # the lines that begin within min_words words of a line's begin, itself the first: the shortest window from it on, if they are enough
    by_words = doc.orderBy("__c")
    span = by_words.rangeBetween(0, min_words - 1)
    runs = kept.select("__id", "__th", "__h", "__pos", "__c", "__e", F.collect_list("__h").over(span).alias("__hs"), F.collect_list("__pos").over(span).alias("__ps"), F.max("__e").over(span).alias("__far"))
    # beside them the line right before: windows start at it and go on with the first of them
    before = F.lag(F.struct("__h", "__pos", "__c", "__e", "__far", F.size("__hs").alias("__n"))).over(by_words)
    runs = runs.select("__id", "__th", "__hs", "__ps", "__c", "__far", before.alias("__s")).where("__s.__e = __c")
    c0, e0, size = F.col("__s.__c"), F.col("__s.__e"), F.size("__hs")
    # how many of them are too few with the first line, and how many without it: the shortest window and the longer ones that need the line
    few = F.when(F.col("__s.__far") - c0 >= min_words, F.greatest(F.col("__s.__n") - 2, F.lit(0))).otherwise(F.col("__s.__n") - 1)
    without = size - F.when(F.col("__far") - e0 >= min_words, 1).otherwise(0)
    runs = runs.withColumn("__few", few).withColumn("__most", F.greatest(without, F.when(e0 - c0 < min_words, F.least(F.col("__few") + 1, size)).otherwise(0)))
    runs = runs.where("__most > __few").withColumn("__n", F.explode(F.sequence(F.col("__few") + 1, F.col("__most"))))
    h = F.slice("__hs", F.lit(1), F.col("__n"))
    windows = runs.select("__id", "__th", F.col("__s.__pos").alias("__pos"), F.element_at("__ps", F.col("__n")).alias("__end"), F.col("__s.__h").alias("__h0"), "__ps", h.alias("__hs"))
    windows = windows.withColumn("__f", F.least("__h0", F.array_min("__hs")))
    place = F.when(F.col("__f") == F.col("__h0"), F.col("__pos")).otherwise(F.element_at("__ps", F.greatest(F.array_position("__hs", F.col("__f")), F.lit(1)).cast("int")))
    windows = windows.select("__id", "__th", "__pos", "__end", F.xxhash64("__h0", "__hs").alias("__window"), "__f", F.xxhash64("__id", "__th", place).alias("__at"))
    # a line that is long enough by itself
    alone = lines.where(F.col("__w") >= min_words).select("__id", "__th", "__pos", F.col("__pos").alias("__end"), F.xxhash64("__h").alias("__window"), F.col("__h").alias("__f"), F.xxhash64("__id", "__th", "__pos").alias("__at"))
    windows = windows.unionByName(alone)
    windows = materialise(windows, "lines-windows")
    twice = materialise(windows.groupBy("__f").agg(F.min("__at").alias("lo"), F.max("__at").alias("hi")).where("lo != hi").select("__f"), "lines-fingerprints")
    near = materialise(windows.join(twice.hint("shuffle_hash"), "__f", "left_semi").drop("__f", "__at"), "lines-near")
    first = near.groupBy("__window").agg(F.min(F.struct("__id", "__th", "__pos", "__end")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialise(first.where("n > 1").select("__window", F.col("first.__id").alias("__i"), F.col("first.__th").alias("__t"), F.col("first.__pos").alias("__p"), F.col("first.__end").alias("__e")), "lines-first")
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__t"))
    later = near.join(first.hint("shuffle_hash"), "__window").where(~same | (F.col("__pos") > F.col("__e"))).select("__id", "__th", "__pos", "__end")
    before = F.max("__end").over(doc.orderBy("__pos", "__end").rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("__new", F.coalesce((F.col("__pos") > before).cast("int"), F.lit(1)))
    islands = islands.withColumn("__run", F.sum("__new").over(doc.orderBy("__pos", "__end").rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("__id", "__th", "__run").agg(F.min("__pos").alias("__from"), F.max("__end").alias("__to")).drop("__run")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, line_ends: Sequence[str] = LINE_ENDS) -> DataFrame:
    """``docs`` without later copies of runs of lines of ``min_words`` words or more, whole, in text order; with ``removed_lines``.

    A line between deleted ones that has no words goes with them. Of rows with the same id and text,
    both lose the same lines: they are one document, and its first copy stays in each. Null texts stay
    null, empty ones empty; a document that repeats others entirely is left with an empty text. Null
    ids come first in the order. Documents with fewer words than ``min_words`` never change. Columns
    other than the text are kept; an existing ``removed_lines`` is replaced. An empty table gives an empty one.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words, line_ends)
    gone = materialise(runs.groupBy("__id", "__th").agg(F.collect_list(F.struct("__from", "__to")).alias("__gone"), F.sum(F.col("__to") - F.col("__from") + 1).alias("__n")), "lines-gone")
    own = docs.drop("removed_lines")
    # the marks grow with the corpus: always a shuffled join
    joined = own.join(gone.hint("shuffle_hash"), own[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(own[text_col]) == gone["__th"]), "left")
    stay = F.filter(text_lines(own[text_col], line_ends), lambda line, i: ~F.exists("__gone", lambda r: (r["__from"] <= i) & (i <= r["__to"])))
    text = F.when(F.col("__gone").isNull(), own[text_col]).otherwise(F.concat_ws("", stay))
    return joined.select(*[text.alias(c) if c == text_col else own[c] for c in own.columns], F.coalesce("__n", F.lit(0)).cast("long").alias("removed_lines"))
