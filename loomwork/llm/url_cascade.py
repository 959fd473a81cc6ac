"""URL filters: exact rule membership by a cascade of Bloom filters, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.ordered import numbered
from loomwork.llm.common import join_small, materialise

#: Hashes per key on each level, and bits per key: the first level lets few keys through, later ones half or so.
FIRST_LEVEL = (7, 12)
LATER_LEVELS = (2, 4)
#: 64-bit words of one filter (256 KB). One filter a level travels inside the plan; larger lists have several, and keys go to theirs.
MOST_WORDS = 1 << 15
#: Up to so many kinds of verdict are named in the plan; more are joined by their numbers.
MOST_NAMES = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    the path from there to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def candidate_keys(host: Column, path: Column, shapes: Mapping[int, Sequence[int]]) -> Column:
    """All (host, path) rules that could cover a url, as host || path; ``shapes`` has the path lengths of the rules by the label count of their hosts.

    Only label counts and lengths that a rule has together are formed. Longer suffixes than any rule's aren't, so a host of very many
    labels costs no more than its length.
    """
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    none = F.array().cast("array<string>")

    def keys(n: int, lengths: Sequence[int]) -> Column:
        suffix, fit = F.substring_index(host, ".", -n), F.filter(F.array(*[F.lit(m) for m in lengths]), lambda m: m <= F.length(path))
        return F.when(labels >= n, F.transform(fit, lambda m: F.concat(suffix, F.substr(path, F.lit(1), m)))).otherwise(none)

    return F.concat(*[keys(n, lengths) for n, lengths in sorted(shapes.items())])


def _slots(key: Column, level: int, hashes: int, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits)) for i in range(hashes)])


def _set_bits(slot: Column) -> tuple[Column, Column]:
    return F.shiftright(slot, 6).cast("int"), F.pmod(slot, F.lit(64)).cast("int")


class BloomCascade:
    """Levels of Bloom filters that answer membership of a key list without error on a given universe of keys.

    Level 0 holds the listed keys. Each further level holds what the level before lets through wrongly:
    level 1 the unlisted keys of the universe that pass level 0, level 2 the listed keys that pass level 1,
    and so on until nothing is left. A key belongs if the number of levels it passes in a row is odd.

    The list and the universe are DataFrames with a string column ``key``. A level has bits in proportion
    to its keys, at most about the listed keys: the first filter lets through fewer unlisted keys than there are listed
    ones, however large the universe (see ``level_bits``), so sizes are bounded by the list, not the corpus. A list
    whose first filter would exceed MOST_WORDS is dealt by a hash to ``shards``, each with a filter a level.
    With one shard, filters are literals and ``contains`` is an expression of the row; with more they
    are a table of a row per shard, and ``with_filters`` brings keys to theirs first.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = materialise(listed.select("key").where("key is not null").distinct(), "cascade-listed")
        universe = materialise(universe.select("key").where("key is not null").join(listed, "key", "left_anti").distinct(), "cascade-universe")
        n_listed, n_other = listed.count(), universe.count()
        first = self.level_bits(n_listed, n_other)
        self.shards = max(1, math.ceil(n_listed * first[1] / 64 / MOST_WORDS))
        self.levels: list[tuple[int, int]] = []
        self.words: list[Column] = []
        self.filters: DataFrame | None = None
        inside, outside, keys = listed, universe, n_listed
        while keys:
            level = len(self.levels)
            hashes, per_key = first if level == 0 else LATER_LEVELS
            words = max(1, math.ceil(keys * per_key / 64 / self.shards))
            self.levels.append((hashes, 64 * words))
            slots = inside.select(self.shard(F.col("key")).alias("shard"), F.explode(_slots(F.col("key"), level, hashes, 64 * words)).alias("slot"))
            word, bit = _set_bits(F.col("slot"))
            set_bits = slots.groupBy("shard", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
            if self.shards == 1:
                array = [0] * words  # at most MOST_WORDS
                for r in set_bits.collect():
                    array[r["word"]] = r["bits"]
                self.words.append(F.split(F.lit(",".join(map(str, array))), ",").cast("array<bigint>"))  # folded to one literal
            else:
                grid = listed.sparkSession.range(self.shards * words).select((F.col("id") % self.shards).cast("int").alias("shard"), F.floor(F.col("id") / self.shards).cast("int").alias("word"))
                dense = grid.join(set_bits, ["shard", "word"], "left").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w"))
                dense = dense.select("shard", F.transform("w", lambda x: x["bits"]).alias(f"__level{level}"))  # at most MOST_WORDS a row
                self.filters = materialise(dense if self.filters is None else self.filters.join(dense, "shard"), "cascade-filters")
                self.words.append(F.col(f"__level{level}"))
            passing = materialise(self.with_filters(outside).where(self._passes(F.col("key"), level)).select("key"), "cascade-level")
            inside, outside, keys = passing, inside, passing.count()

    @staticmethod
    def level_bits(n_listed: int, n_other: int) -> tuple[int, int]:
        """Hashes and bits per key of the first level: enough that false positives are fewer than the listed keys."""
        need = math.log2(max(2.0, n_other / max(n_listed, 1))) + 1
        hashes = max(FIRST_LEVEL[0], math.ceil(need))
        return hashes, max(FIRST_LEVEL[1], math.ceil(hashes / math.log(2)))

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.shards)).cast("int")

    def with_filters(self, keys: DataFrame) -> DataFrame:
        """``keys`` (column ``key``) beside the filters of their shard, where these aren't literals."""
        if self.filters is None:
            return keys
        return keys.withColumn("shard", self.shard(F.col("key"))).join(self.filters.hint("shuffle_hash"), "shard")

    def _passes(self, key: Column, level: int) -> Column:
        hashes, bits = self.levels[level]

        def is_set(slot: Column) -> Column:
            word, bit = _set_bits(slot)
            return F.getbit(F.get(self.words[level], word), bit) == 1

        return F.forall(_slots(key, level, hashes, bits), is_set)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe or the list is listed."""
        out = F.lit(len(self.levels) % 2 == 1)  # passes them all
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``: a rule covers its host and all subdomains where the
    url's path starts with the rule's path. The longest covering rule (host and path together; of equally
    long ones the last by code point) gives the verdict; a url that no rule covers gets ``default`` and a
    null rule.

    A cascade tells which of the corpus's keys (every host suffix with every path prefix that a rule could name)
    are rules, and one cascade for each binary digit of the verdicts' numbers tells a rule's verdict, whatever
    their number. Each url's keys are looked up in the row itself. Lists of several filters (over about
    170,000 rules) are asked once for every distinct key, which goes to its filter's task, and the answers go to the urls.

    Urls that are null or have no ``://`` have empty host and path, and no rule. Rules with null host or
    verdict are ignored, and so are those whose path doesn't start with ``/``, which no url's does; a null path
    counts as empty; of rules that repeat a key, the least verdict counts. No rules: all get ``default``. Hosts and
    paths of any length are taken whole. Repeated rows and other columns stay; ``host``, ``path``, ``rule``
    and ``verdict`` of the input are replaced.
    """
    host, path = split_url(F.col(url_col))
    d = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    rules = rules.where("host is not null and verdict is not null").select(_lower(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").where("p = '' or startswith(p, '/')")
    rules = rules.groupBy("h", "p").agg(F.min("verdict").alias("verdict"))
    labels = F.length("h") - F.length(F.replace(F.col("h"), F.lit("."), F.lit(""))) + 1
    rules = materialise(rules.select(F.concat("h", "p").alias("key"), "verdict", F.length("p").alias("n"), labels.alias("labels")), "url-rules")
    shapes = {r["labels"]: sorted(r["n"]) for r in rules.groupBy("labels").agg(F.collect_set("n").alias("n")).collect()}  # distinct lengths: bounded by the longest rule
    if not shapes:
        return d.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    names = materialise(numbered(rules.select("verdict").distinct(), ["verdict"], "number").withColumn("number", F.col("number") - 1), "url-verdicts")
    kinds = names.count()
    rules = materialise(rules.join(names, "verdict").select("key", "number"), "url-rules")
    keyed = d.withColumn("__keys", F.when(F.col("host") != "", candidate_keys(F.col("host"), F.col("path"), shapes)).otherwise(F.array().cast("array<string>")))
    universe = materialise(keyed.select(F.explode("__keys").alias("key")).distinct(), "url-universe")
    listed = BloomCascade(rules, universe)
    digits = [BloomCascade(rules.where(F.getbit("number", F.lit(i)) == 1), rules) for i in range((kinds - 1).bit_length())]

    def number(key: Column) -> Column:
        return sum((F.when(c.contains(key), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(digits)), F.lit(0)).cast("long")

    if listed.shards == 1 and all(c.shards == 1 for c in digits):
        held = F.transform(F.filter("__keys", listed.contains), lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))
        judged = keyed.withColumn("rule", F.array_max(held)["key"]).drop("__keys").withColumn("__number", F.when(F.col("rule").isNotNull(), number(F.col("rule"))))
    else:
        found = listed.with_filters(universe).where(listed.contains(F.col("key"))).select("key", F.lit(0).cast("long").alias("number"))
        for i, c in enumerate(digits):
            found = c.with_filters(materialise(found, "url-found")).select("key", (F.col("number") + F.when(c.contains(F.col("key")), 1 << i).otherwise(0)).alias("number"))
        found = materialise(found, "url-found")
        urls = keyed.select("host", "path", F.explode("__keys").alias("key")).distinct()
        best = join_small(urls, found, ["key"], salt=F.xxhash64("host", "path")).groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "number")).alias("b"))
        best = materialise(best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("b.key").alias("rule"), F.col("b.number").alias("__number")), "url-best")
        on = (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path"))
        judged = keyed.drop("__keys").join(best, on, "left").drop("__host", "__path")
    if kinds <= MOST_NAMES:
        known = [r["verdict"] for r in names.orderBy("number").collect()]
        verdict = F.get(F.array(*[F.lit(v) for v in known]), F.col("__number").cast("int"))
        return judged.withColumn("verdict", F.coalesce(verdict, F.lit(default))).drop("__number")
    judged = join_small(judged, names.select(F.col("number").alias("__number"), F.col("verdict")), ["__number"], "left", salt=F.xxhash64("host", "path"))
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop("__number")
