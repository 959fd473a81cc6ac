"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import join_small, materialise, word_count

#: Bits of the hash of a document's id and text, and bits that each level of the histogram resolves.
HASH_BITS = 60
LEVEL_BITS = 12
#: Lots that equal rows at a threshold are counted out in.
TIE_LOTS = 1024


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """The words that each source is to give; ``sizes`` has ``__key``, ``__source`` and ``source_size``, a row per source.

    Sources in code-point order, null last, take the weights in turn and share the total of all
    sizes. A target stops at ``max_repeat`` times its source's size, and the excess goes to the others
    by weight: target = min(cap, level x weight), with the level that makes the targets' sum the total.
    """
    n = len(weights)
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("__source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("w_left"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"])
    return s.select("__key", "__source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _text_hash(id_col: str, text_col: str) -> Column:
    """The first HASH_BITS bits of the MD5 of id and text; rows that share it are copies of each other."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(text_col)))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``: how often the mix takes each document.

    A source's whole number of passes over its documents (target / size, rounded down) is taken of
    every document; of the rest, those whose hash of id and text lies below the source's threshold are taken
    once more. Thresholds are exact: words are summed by source and leading hash bits, the bucket in
    which the running sum passes the budget is found, and only that bucket is refined by the next bits,
    until it holds one hash value. No documents are sorted, and the histogram of a level has at most
    2**12 rows per source. Rows that share the threshold's hash (equal id and text) are counted out, see
    ``_tied_rows``: a source misses its target by less than one document, whatever repeats.

    Null text has size 0 and is taken 0 words (its ``copies`` follow the same rule as others'). Null
    sources are one source, ordered last. Null ids count as empty in the hash, which the text tells apart. An
    empty table gives an empty table. Columns of the same names as the new ones are replaced; internal
    columns start with ``__``.
    """
    d = docs.withColumn("size", word_count(F.col(text_col)))
    d = d.withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")))
    d = d.withColumn("__h", _text_hash(id_col, text_col))
    sized = materialise(d.select("__key", F.col(source_col).alias("__source"), "size", "__h"), "mix-sizes")
    sums = materialise(sized.groupBy("__key", "__source").agg(F.sum("size").alias("source_size")), "mix-sums")
    goal = source_targets(sums, weights, max_repeat)
    goal = goal.withColumn("__passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = materialise(goal.withColumn("__rest", F.col("target") - F.col("__passes") * F.col("source_size")), "mix-goal")

    # One row per source: the bucket that holds the threshold, what lies below it, and the hashes in it.
    edge = goal.where("source_size > 0").select("__key", "__rest", F.lit(0).cast("long").alias("__bucket"), F.lit(0).cast("long").alias("__below"))
    thresholds, shift = None, HASH_BITS
    while shift > 0 and not edge.isEmpty():
        inside = join_small(sized.where("size > 0").withColumn("__bucket", F.shiftright("__h", shift)), edge, ["__key", "__bucket"], salt=F.col("__h"))
        shift -= LEVEL_BITS
        inside = inside.withColumn("__bucket", F.shiftright("__h", shift))
        level = inside.groupBy("__key", "__bucket").agg(
            F.sum("size").alias("t"), F.count(F.lit(1)).alias("rows"), F.min("__h").alias("lo"), F.max("__h").alias("hi"), F.first("__rest").alias("__rest"), F.first("__below").alias("__below")
        )
        run = Window.partitionBy("__key").orderBy("__bucket")
        level = level.withColumn("upto", F.col("__below") + F.sum("t").over(run))
        crossing = level.where("upto > __rest").groupBy("__key").agg(F.min_by(F.struct("__bucket", (F.col("upto") - F.col("t")).alias("__below"), "lo", "hi", "rows", "__rest"), "__bucket").alias("x"))
        crossing = materialise(crossing.select("__key", "x.*"), "mix-level")
        # what the rows at the threshold may still give; one row alone is too long for it
        left = F.when(F.col("rows") > 1, F.floor(F.col("__rest") - F.col("__below"))).otherwise(F.lit(0)).cast("long")
        found = crossing.where("lo = hi").select("__key", F.col("lo").alias("__threshold"), left.alias("__left"))
        thresholds = found if thresholds is None else thresholds.union(found)
        edge = crossing.where("lo < hi").select("__key", "__rest", "__bucket", "__below")
    if thresholds is None:
        thresholds = goal.select("__key", F.lit(0).cast("long").alias("__threshold"), F.lit(0).cast("long").alias("__left"))
    plan = goal.join(thresholds, "__key", "left").select("__key", "source_size", "target", "__passes", F.coalesce("__threshold", F.lit(0)).alias("__threshold"), F.coalesce("__left", F.lit(0)).alias("__left"))
    plan = materialise(plan, "mix-plan")
    d = join_small(d.drop("source_size", "target", "copies", "taken"), plan, ["__key"], salt=F.col("__h"))
    once_more = (F.col("__h") < F.col("__threshold")).cast("long")
    if plan.where("__left > 0").isEmpty():
        d = d.withColumn("copies", F.col("__passes") + once_more)
    else:
        tied = (F.col("__h") == F.col("__threshold")) & (F.col("__left") > 0) & (F.col("size") > 0)
        d = d.where(~tied).withColumn("copies", F.col("__passes") + once_more).unionByName(_tied_rows(d.where(tied)))
    return d.withColumn("taken", F.col("size") * F.col("copies")).drop("__key", "__h", "__passes", "__threshold", "__left")


def _tied_rows(d: DataFrame) -> DataFrame:
    """Rows that share their source's threshold, with ``copies``: as many are taken once more as ``__left`` words allow.

    They are copies of each other, so any of them will do. They are written with a number each (only then
    is it the same in every pass), dealt to lots by it, and a lot takes what the lots before it leave; so a
    document that is a third of all rows isn't one task's work.
    """
    rows = materialise(d.withColumn("__n", F.monotonically_increasing_id()).withColumn("__lot", F.pmod(F.xxhash64("__n"), F.lit(TIE_LOTS)).cast("int")), "mix-tied")
    lots = rows.groupBy("__key", "__lot").agg(F.sum("size").alias("t"))  # at most TIE_LOTS a source
    lots = materialise(lots.select("__key", "__lot", (F.sum("t").over(Window.partitionBy("__key").orderBy("__lot")) - F.col("t")).alias("__before")), "mix-lots")
    upto = F.col("__before") + F.sum("size").over(Window.partitionBy("__key", "__lot").orderBy("__n"))
    out = join_small(rows, lots, ["__key", "__lot"]).withColumn("copies", F.col("__passes") + (upto <= F.col("__left")).cast("long"))
    return out.drop("__n", "__lot", "__before")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    mixed = mix_sources(docs.withColumns({f"__in_{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}), **options)
    rows = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)])
