"""Made-up people, for demonstrations; the same for the same seed on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ("Ana", "Ben", "Chloe", "Dev", "Ewa", "Femi", "Gia", "Hugo")
LAST = ("Adams", "Bauer", "Costa", "Dunn", "Evans", "Fischer")
DOMAINS = ("example.com", "example.net", "example.org")


def people(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, name, email): names drawn by hashes of the id; addresses are the lower-cased names with ``_``."""
    pick = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(words))).cast("int"))
    d = spark.range(n).withColumn("name", F.concat_ws(" ", pick(FIRST, 1), pick(LAST, 2)))
    return d.withColumn("email", F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("_"))), F.lit("@"), pick(DOMAINS, 3)))
