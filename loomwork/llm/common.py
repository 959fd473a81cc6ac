"""What the training-data operators share: the shared folder, materialised tables, size-checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.core import shared_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows may be broadcast; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 10_000
SALTS = 32


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``), below one of this application's own."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut, and lost executors cost nothing.

    ``loomwork.functions.core.drop_stored`` removes what an application has written, once its results are out.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt: Column | None = None) -> DataFrame:
    """Join a table that is expected to be small: broadcast after a count shows that it is, else shuffled.

    ``small`` should be a written table, since it is counted first. Beyond the bound, ``salt`` (any
    well-spread column expression of ``big``) deals the rows of a hot key to many tasks.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    if salt is None:
        return big.join(small, keys, how)
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, [*keys, "__salt"], how).drop("__salt")


def word_count(text: Column) -> Column:
    """Words of a whole text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` to as many tasks as the session shuffles to.

    The number is given, so adaptive execution doesn't merge tasks whose rows are few but whose work isn't.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
